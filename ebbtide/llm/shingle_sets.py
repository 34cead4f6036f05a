"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: an exact join and its components."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.components import connected_components
from ebbtide.llm.tables import discard, with_size_checked
from ebbtide.llm.text import held, text_bytes
from ebbtide.session import FEW_ROWS, materialized

SEED = 42
WORDS = 5
#: Texts from which common shingles are learned, and how many of them hold one. They only order the shingles: any
#: order gives the same links, a good one fewer candidates.
ORDER_TEXTS = 20_000
ORDER_LEAST = 16
#: Texts with a candidate are picked out by a broadcast of their numbers up to so many (8 bytes each), else by a join.
CANDIDATES_BROADCAST = 500_000
#: Texts whose sets a worker hands on together.
BATCH_TEXTS = 400


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes, words=WORDS):
    """Sorted distinct 64-bit hashes of all runs of ``words`` lower-case words; a shorter text is one run."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    known = {t: xxhash.xxh64_intdigest(t, SEED) for t in set(tokens)}
    hashes = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
    length = min(words, len(tokens))
    n = len(tokens) - length + 1
    found = np.full(n, length, np.uint64)
    for k in range(length):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(found.view(np.int64))


def _lists(arrays) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sliced(batches):
    """Record batches of at most ``BATCH_TEXTS`` rows: of a large one only a slice is there as Python values at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_TEXTS):
            yield batch.slice(first, BATCH_TEXTS)
        pa.default_memory_pool().release_unused()


def _set_batches(batches, prints_of, n_prints):
    """``node, n, shingles, f0 ...`` in small batches, from batches of ``node, bytes``."""
    held("shingles", dict)  # what an earlier stage kept in this worker goes
    names = ["node", "n", "shingles", *[f"f{i}" for i in range(n_prints)]]
    for part in _sliced(batches):
        sets = [shingles_of(t) for t in part.column("bytes").to_pylist()]
        prints = np.array([prints_of(s.view(np.uint64)) for s in sets], np.int64).reshape(len(sets), n_prints)
        columns = [part.column("node"), pa.array([len(s) for s in sets], pa.int32()), _lists(sets)]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, prints.T.copy())], names)


def shingle_sets(docs: DataFrame, prints_of, n_prints) -> DataFrame:
    """``node, n, shingles, f0 ...`` of every distinct text; node is the text's hash. A null text is an empty one.

    ``prints_of`` gives the ``n_prints`` fingerprints of a set. Sets leave the worker in small batches.
    """
    texts = docs.select(text_bytes().alias("bytes")).withColumn("node", F.xxhash64("bytes"))
    once = texts.groupBy("node").agg(F.first("bytes").alias("bytes"))
    prints = "".join(f", f{i} long" for i in range(n_prints))
    return once.mapInArrow(
        lambda batches: _set_batches(batches, prints_of, n_prints), f"node long, n int, shingles array<long>{prints}"
    )


def _common_shingles(sets):
    """Sorted shingles that many texts hold, and how many texts hold them."""
    every = max(1, sets.count() // ORDER_TEXTS)
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    found = some.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= ORDER_LEAST)
    rows = found.toPandas().sort_values("s")
    return rows["s"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def prefix_of(shingles, common, counts):
    """The first shingles in the order of (texts that hold it, hash), as many as a partner cannot miss altogether.

    Two sets with a similarity of 0.8 share at least 0.8 of either one's n shingles. In an order that holds for all
    texts, the smallest one that they share is therefore among the first n - ceil(0.8 n) + 1 of both. An empty set has
    the place zero.
    """
    n = len(shingles)
    if n == 0:
        return np.zeros(1, np.int64)
    order = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        order = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.argsort(order, kind="stable")[: n - (4 * n + 4) // 5 + 1]]


def _place_batches(batches, common, counts):
    """A row ``node, n, at, place`` for each place of a set's prefix, from batches of ``node, n, shingles``."""
    held("shingles", dict)
    for part in _sliced(batches):
        lists = part.column("shingles")
        ends = np.cumsum(lists.value_lengths().to_numpy())
        found = [prefix_of(s, common, counts) for s in np.split(lists.flatten().to_numpy(), ends[:-1])]
        sizes = [len(f) for f in found]
        columns = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "n")]
        columns += [np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]), np.concatenate(found)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "at", "place"])


def _similar(shared, n, other):
    """shared / (n + other - shared) >= 0.8 in whole numbers; two empty sets are equal."""
    return 9 * shared >= 4 * (n + other)


def _confirmed(pairs, sets, likely):
    """Pairs ``a, b`` whose sets are similar enough. Only sets of texts that are in a likely pair move."""
    if likely is not None:
        pairs = materialized(likely(pairs), "shingle-likely")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets.join(with_size_checked(nodes, CANDIDATES_BROADCAST), "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(left, "a").join(right, "b").where(_similar(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")


def linked_sets(sets: DataFrame, likely=None) -> DataFrame:
    """``node, component`` of all texts that links reach but the smallest node of each component.

    ``sets`` has distinct rows ``node, n, shingles``. A link is a pair with a Jaccard similarity of 0.8 or more of the
    sets; every such pair shares a shingle of both prefixes and meets there, at every size of the table. Dense groups
    of near copies would pair all with all, so links are found in passes: each text is compared with the smallest one
    of its places, then texts whose components still differ are compared in the places that hold both. ``likely`` may
    leave pairs out before their sets are compared.
    """
    spark = sets.sparkSession
    common, counts = _common_shingles(sets)

    # Rows leave the worker one for each place: whole prefixes and sets are never held beside them.
    places = sets.select("node", "n", "shingles").mapInArrow(
        lambda batches: _place_batches(batches, common, counts), "node long, n int, at int, place long"
    )
    places = materialized(places, "shingle-prefixes", FEW_ROWS)
    shared = places.groupBy("place").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("held"))
    # Written before they are joined, so that a place that very many texts share can be split.
    shared = materialized(shared.where("held > 1").select("place", "first"), "shingle-shared")
    members = materialized(places.join(shared, "place"), "shingle-members")
    discard(spark, places)
    discard(spark, shared)

    near_size = lambda n, m: 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    to_first = members.where((F.col("node") > F.col("first.node")) & near_size(F.col("n"), F.col("first.n")))
    to_first = materialized(to_first.select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct(), "to-first")
    links = materialized(_confirmed(to_first, sets, likely), "shingle-links")
    discard(spark, to_first)
    found = materialized(connected_components(links), "shingle-components")

    labelled = members.drop("first").join(found, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    # Both sides of the meeting are written plain rows, and a place that has become one component is left out.
    labelled = materialized(labelled, "shingle-labelled")
    discard(spark, members)
    several = labelled.groupBy("place").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = materialized(several.where("lo <> hi").select("place"), "shingle-several")
    left = materialized(labelled.join(several, "place"), "shingle-open")
    discard(spark, labelled)
    right = left.select("place", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "at", "component")])
    meeting = left.join(right, "place").where(
        (F.col("component") < F.col("other_component")) & near_size(F.col("n"), F.col("other_n"))
    )
    # What two texts share starts at the first place where they meet; the rest of either bounds it.
    met = meeting.groupBy(F.col("node").alias("a"), F.col("other_node").alias("b")).agg(
        F.max(F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))).alias("most"),
        F.first("n").alias("n"),
        F.first("other_n").alias("m"),
    )
    met = materialized(met.where(_similar(F.col("most"), F.col("n"), F.col("m"))).select("a", "b"), "shingle-met")
    return connected_components(links.union(_confirmed(met, sets, likely)))
