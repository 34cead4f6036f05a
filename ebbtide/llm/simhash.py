"""SimHash near-duplicates: fingerprints, links found with pivot distance tables, components."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import shingle_sets
from ebbtide.llm.components import connected_components
from ebbtide.llm.tables import discard
from ebbtide.llm.text import text_bytes
from ebbtide.session import FEW_ROWS, materialized

SEED = 42
WORDS = 4
RADIUS = 4
#: Reference fingerprints; the distance to each takes one byte of a table entry.
PIVOTS = 16
#: Fingerprints of a shingle set (64 bits each), and the differing bits up to which two sets may be similar. Sets with a
#: Jaccard similarity of 0.8 differ in 39 of 256 bits on average (standard deviation 5.7), at 0.45 in 72. Of sets shorter
#: than SHORT_SET a few shingles decide each bit, so their fingerprints rule nothing out.
SET_PRINTS = 4
SET_RADIUS = 72
SHORT_SET = 20


def _shingle_hashes(text, words):
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])], np.uint64)


def _other_hashes(hashes, which):
    """Hashes as good as new ones, from those at hand: a mixing step keyed by the number of the fingerprint."""
    if which == 0:
        return hashes
    x = hashes * np.uint64(2 * which + 1) + np.uint64(0x9E3779B97F4A7C15 * which % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(text: bytes, words=WORDS, n_prints=1, block=65_536):
    """Signed 64-bit SimHashes: a bit is 1 if it is set in over half of the shingle hashes. No words: 0."""
    return _prints(_shingle_hashes(text, words), n_prints, block)


def _prints(hashes, n_prints, block=65_536):
    found = []
    for which in range(n_prints):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), block):
            part = _other_hashes(hashes[i : i + block], which)
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(ones * 2 > len(hashes)).view("<i8")[0]))
    return found


def fingerprint_of(text: bytes, words=WORDS) -> int:
    return fingerprints_of(text, words)[0]


def fingerprints(column, words=WORDS, n_prints=1):
    """Array of ``n_prints`` fingerprints of a text (bytes)."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprints_of(t, words, n_prints) for t in texts], dtype=object)

    return of(column)


def hamming(left, right):
    """Differing bits of two lists of fingerprint columns."""
    return sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(left, right)), F.lit(0))


def _reference(which, of_print):
    """Reference fingerprints spread over the space by a fixed sequence of hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(b"pivot %d of %d" % (which, of_print), SEED) - 2**63


def with_pivots(table: DataFrame, columns, prefix) -> DataFrame:
    """Adds the pivot table entry of fingerprint columns: distances to all reference fingerprints, eight to a long.

    Distances stop at 255; that can only make coordinates look closer.
    """
    entries = {}
    for i in range(0, PIVOTS, 8):
        packed = F.lit(0).cast("long")
        for k in range(8):
            parts = [F.bit_count(F.col(c).bitwiseXOR(F.lit(_reference(i + k, j)))) for j, c in enumerate(columns)]
            distance = F.least(sum(parts, F.lit(0)), F.lit(255)).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(distance, 8 * k))
        entries[f"{prefix}{i // 8}"] = packed
    return table.withColumns(entries)


def _within_pivots(prefix, other, radius):
    """No coordinate of two table entries differs by more than the radius (else the distance is larger, too)."""
    kept = F.lit(True)
    for i in range(PIVOTS):
        a, b = (
            F.shiftright(F.col(f"{p}{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for p in (prefix, other)
        )
        kept = kept & (F.abs(a - b) <= radius)
    return kept


def _block_masks(n_blocks, radius):
    """Masks of all but ``radius`` of the blocks: two fingerprints within the radius agree under at least one."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return [signed(sum(kept)) for kept in combinations(blocks, n_blocks - radius)]


def _n_blocks(count, radius):
    """Fewest blocks whose shared bits tell ``count`` fingerprints apart; only the work depends on it."""
    n = radius + 1
    while 64 * (n - radius) // n < np.log2(max(count, 2)) and n < 2 * radius + 2:
        n += 1
    return n


def linked_fingerprints(prints: DataFrame, radius=RADIUS) -> DataFrame:
    """Components of texts linked at ``radius`` or fewer differing bits.

    ``prints`` has distinct rows ``node, f0``: a number and the text's fingerprint. Result: ``node, component`` for all
    but the smallest node of each component of two or more. Fingerprints meet under masks, every pair in reach once at
    least. There the pivot distance tables discard pairs whose largest coordinate difference exceeds the radius, and
    the bits of the survivors are compared.

    Dense groups of near copies would pair all with all, so links are found in passes. The first compares each text
    only with the smallest one of its place. The second compares only texts whose components still differ; a place
    that has become one component is left out.
    """
    own = ["f0"]
    pivots = [f"p{i}" for i in range(PIVOTS // 8)]
    table = with_pivots(prints.select("node", *own), own, "p")
    masks = _block_masks(_n_blocks(prints.count(), radius), radius)
    at = [F.col("f0").bitwiseAND(F.lit(m)) for m in masks]
    places = table.select("*", F.posexplode(F.array(*at)).alias("mask", "bits"))
    shared = places.groupBy("mask", "bits").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written before they are joined, here and below, so that a place that very many texts share can be split.
    shared = materialized(shared.drop("n"), "simhash-shared")
    members = materialized(places.join(shared, ["mask", "bits"]), "simhash-places")

    others = [f"o{c}" for c in own]
    other_pivots = [f"q{i}" for i in range(PIVOTS // 8)]
    renamed = dict(zip([*own, *pivots], [*others, *other_pivots]))
    first = table.withColumnsRenamed({"node": "first", **renamed})
    is_link = _within_pivots("p", "q", radius) & (hamming(own, others) <= radius)
    to_first = members.where("node <> first").select("node", "first", *own, *pivots).distinct()
    links = to_first.join(first, "first").where(is_link).select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = materialized(links.distinct(), "simhash-links")
    found = materialized(connected_components(links), "simhash-components")

    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_places = (
        labelled.groupBy("mask", "bits")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("mask", "bits")
    )
    open_places = materialized(open_places, "simhash-open-places")
    left = materialized(labelled.join(open_places, ["mask", "bits"]), "simhash-open")
    right = left.select(
        F.col("mask").alias("other_mask"),
        F.col("bits").alias("other_bits"),
        F.col("component").alias("other_component"),
        *[F.col(c).alias(renamed[c]) for c in [*own, *pivots]],
    )
    meet = (F.col("mask") == F.col("other_mask")) & (F.col("bits") == F.col("other_bits"))
    across = (
        left.join(right, meet & (F.col("component") < F.col("other_component")) & is_link)
        .select(F.col("component").alias("a"), F.col("other_component").alias("b"))
        .distinct()
    )
    return connected_components(links.union(across))


def near_duplicates(docs: DataFrame, words=WORDS, radius=RADIUS) -> DataFrame:
    """``doc_id, text_hash, component, fingerprint, component_id`` for every row of ``doc_id, text``.

    A null text is empty; texts without words have fingerprint zero and are linked like any other. component_id is
    the smallest doc_id that links reach; rows without a doc_id join in, but name a component only as null where
    all its rows lack one. Repeated rows are rows of the same component. Copies share a fingerprint and are searched
    once. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        fingerprints(text_bytes(), words)[0].alias("f0"),
    )
    rows = materialized(rows.withColumn("node", F.col("f0")), "simhash-rows")
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("smallest"), F.max("f0").alias("f0"))
    distinct = materialized(distinct, "simhash-distinct")
    components = materialized(linked_fingerprints(distinct, radius), "simhash-merged")
    labelled = distinct.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = labelled.join(smallest, "component").select("node", "component", "component_id")
    return rows.join(named, "node").select(
        "doc_id",
        "text_hash",
        "component",
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _set_prints(hashes):
    """SimHashes of a set of shingles, each distinct shingle once."""
    return _prints(hashes, SET_PRINTS)


def _in_reach(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes that the pivot tables do not discard and whose fingerprints differ in few enough bits.

    ``table`` has ``node, n``, fingerprints and pivot table entries.
    """
    own, others = ([f"{p}{i}" for i in range(SET_PRINTS)] for p in "fo")
    pivots, other_pivots = ([f"{p}{i}" for i in range(PIVOTS // 8)] for p in "pq")
    left = table.withColumnRenamed("node", "a")
    right = table.withColumnsRenamed({"node": "b", "n": "m", **dict(zip([*own, *pivots], [*others, *other_pivots]))})
    near = _within_pivots("p", "q", SET_RADIUS) & (hamming(own, others) <= SET_RADIUS)
    return pairs.join(left, "a").join(right, "b").where((F.least("n", "m") < SHORT_SET) | near).select("a", "b")


def near_duplicate_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, component`` for every row of ``doc_id, text``: texts linked by fingerprints and sets.

    A link is a pair whose SimHashes are in reach of each other, by the pivot tables and by the bits, and whose five-word
    shingles then have a Jaccard similarity of 0.8 or more. Masks of fingerprints lose pairs at such a distance, so texts
    meet under rare shingles (``shingle_sets``); whole sets move only for pairs that the fingerprints leave.
    """
    spark = docs.sparkSession
    sets = materialized(shingle_sets.shingle_sets(docs, _set_prints, SET_PRINTS), "shingle-sets", FEW_ROWS)
    own = [f"f{i}" for i in range(SET_PRINTS)]
    table = materialized(with_pivots(sets.select("node", "n", *own), own, "p"), "shingle-prints")
    found = shingle_sets.linked_sets(sets.select("node", "n", "shingles"), lambda pairs: _in_reach(pairs, table))
    components = materialized(found, "shingle-merged")
    discard(spark, sets)
    discard(spark, table)
    rows = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(text_bytes()).alias("node")
    )
    labelled = rows.join(components, "node", "left")
    return labelled.select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of every component, with all its columns: the one with the smallest doc_id.

    Texts count as near-duplicates when their SimHashes are in reach of each other and their sets of five-word shingles
    have a Jaccard similarity of 0.8 or more. Rows without a doc_id come last; ties go to the smallest text hash, and a repeated row stays once.
    """
    found = near_duplicate_sets(docs)
    same = ["component", "doc_id", "text_hash"]
    rows = found.groupBy(*same).agg(F.count("*").alias("n_rows"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n_rows")
    kept = rows.groupBy("component").agg(F.min(order).alias("kept")).select(
        F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"), "kept.n_rows"
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("kept_id"),
        F.xxhash64("text").alias("kept_hash"),
    )
    staying = whole.alias("w").join(
        kept.alias("k"),
        F.col("w.kept_hash").eqNullSafe(F.col("k.kept_hash")) & F.col("w.kept_id").eqNullSafe(F.col("k.kept_id")),
    ).select("row", "n_rows", "w.kept_id", "w.kept_hash")
    once = staying.where("n_rows = 1").select("row")
    repeated = staying.where("n_rows > 1").dropDuplicates(["kept_id", "kept_hash"]).select("row")
    return once.union(repeated).select("row.*")
