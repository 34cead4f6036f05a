"""Connected components of links between numbers, by alternating star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import discard
from ebbtide.session import materialized


def _signature(edges):
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1_000_003)).head()
    return tuple(row)


def _large_star(edges):
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(smallest, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges):
    """Every node and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (
        edges.join(smallest, "a")
        .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        .select("e.a", F.col("e.m").alias("b"))
        .where(F.col("a") > F.col("b"))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (columns a, b) that is not the smallest of its component.

    Links may repeat, go either way or join a node to itself. Smallest neighbours are found by a grouped minimum and
    joined back, so a node with very many neighbours is split over tasks like any other. Each step is written to the
    shared folder; the number of steps grows with the logarithm of a component's size.
    """
    spark = links.sparkSession
    edges = materialized(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _signature(edges)
    while before[0]:
        stepped = materialized(_small_star(_large_star(edges)), "links")
        discard(spark, edges)
        edges, now = stepped, _signature(stepped)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
