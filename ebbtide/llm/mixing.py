"""Mixing sources to target weights: how often each document is taken, and the mix itself.

Every column here is a built-in function: whole numbers of copies come from the source's rate, the rest from one
seeded hash of the document.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.tables import with_size_checked
from ebbtide.llm.text import WORD
from ebbtide.session import materialized

#: Weights by place of the source in code point order, repeated; sources may be taken this often at most.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3


def word_count(column="text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_rate=MAX_RATE) -> DataFrame:
    """Target of each source: ``source, source_size, target``.

    ``sizes`` has ``source, size``. Sources share the total by weight; a target stops at ``max_rate`` times the
    source's size, and the excess goes to the others by weight until none is above. That is one water level: with
    sources in order of cap / weight, those before the level stand at their caps and the rest at level * weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # From here on one row for each source.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    leveled = (
        totals.withColumn("weight", weight)
        .withColumns(
            {
                "cap": (F.col("source_size") * max_rate).cast("double"),
                "total": F.sum("source_size").over(every).cast("double"),
                "all_weights": F.sum("weight").over(every),
            }
        )
        .withColumn("level", level)
        .withColumn("is_free", F.col("level") * F.col("weight") <= F.col("cap"))
        # The first source in that order that is not lifted to its cap fixes the level; later ones compute lower levels.
        .withColumn("water", F.max(F.when(F.col("is_free"), F.col("level"))).over(every))
    )
    target = F.when(
        F.col("water").isNull() | (F.col("water") * F.col("weight") > F.col("cap")), F.col("cap")
    ).otherwise(F.col("water") * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def copies(rate, seed, *identity):
    """Whole copies of the rate plus one with the probability of its fraction, from a hash of the identity."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(2**53)) / F.lit(float(2**53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, weights=WEIGHTS, max_rate=MAX_RATE, seed=42) -> DataFrame:
    """``doc_id, source, row_hash, size, source_size, target, rate, n_copies`` for every row of ``doc_id, text, source``.

    A null text has size 0, a source without words rate 0, null is a source of its own (last in order). Rows that
    repeat doc_id and text get the same draw. Nothing depends on the order of rows, so reruns agree. An empty table
    gives no rows; other columns are not read.
    """
    sizes = materialized(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64("doc_id", "text").alias("row_hash"),
            word_count().alias("size"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, max_rate).select(
        F.col("source").alias("target_source"), "source_size", "target"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sizes.join(with_size_checked(targets), F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("rate", F.least(rate, F.lit(float(max_rate))))
        .select(
            "doc_id",
            "source",
            "row_hash",
            "size",
            "source_size",
            "target",
            "rate",
            copies(F.col("rate"), seed, F.col("row_hash")).alias("n_copies"),
        )
    )


def emit(docs: DataFrame, weights=WEIGHTS, max_rate=MAX_RATE, seed=42) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as it is taken.

    The rate of a source is looked up in the table of sources, and the draw is repeated from the row itself, so the
    texts need no join by document. Columns of ``docs`` may have any name.
    """
    rated = with_size_checked(source_rates(docs, weights, max_rate))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("row_source"),
        F.xxhash64("doc_id", "text").alias("row_hash"),
    )
    taken = row.join(rated, F.col("row_source").eqNullSafe(F.col("target_source"))).withColumn(
        "n_copies", copies(F.col("rate"), seed, F.col("row_hash"))
    )
    return (
        taken.where(F.col("n_copies") > 0)
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
        .select("row.*")
    )


def source_rates(docs: DataFrame, weights=WEIGHTS, max_rate=MAX_RATE) -> DataFrame:
    """``target_source, rate`` of every source."""
    sizes = docs.select(F.col("source").cast("string").alias("source"), word_count().alias("size"))
    targets = source_targets(sizes, weights, max_rate)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.select(
        F.col("source").alias("target_source"), F.least(rate, F.lit(float(max_rate))).alias("rate")
    )
