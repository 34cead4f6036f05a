"""Line dedup by pairwise alignment: common blocks of lines go from the later of two overlapping documents."""

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import discard
from ebbtide.llm.text import held, order_id, row_hash
from ebbtide.session import materialized, scratch_path

#: A line leads to another document only if it has this many characters; shorter ones meet by chance.
SEED_CHARS = 24
#: A line in at most so many documents is rare: it leads to every earlier holder at once. Others lead to the first
#: holder, and where they stay after that, to the other earlier holders they can anchor with, in rounds.
RARE_DOCUMENTS = 4
#: Turn of the document that stands for its id (below any other's, which is its hash).
FIRST_TURN = -(2**63)
#: An aligned block goes only if its lines have this many characters together.
BLOCK_CHARS = 24


def _unique_anchors(a, b, a_lo, a_hi, b_lo, b_hi):
    """Pairs of places of lines that occur once on either side, in the longest order they share."""
    places_a, places_b = {}, {}
    for places, lines, lo, hi in ((places_a, a, a_lo, a_hi), (places_b, b, b_lo, b_hi)):
        for i in range(lo, hi):
            places[lines[i]] = -1 if lines[i] in places else i
    pairs = [(i, places_b.get(line, -1)) for line, i in places_a.items() if i >= 0]
    pairs = [(i, j) for i, j in pairs if j >= 0]  # in order of i
    tails, tail_of, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(tail_of[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            tail_of.append(k)
        else:
            tails[at], tail_of[at] = j, k
    chain, k = [], tail_of[-1] if tail_of else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def patience(a, b):
    """Aligned places (i, j) of two lists of lines, both ascending.

    Equal lines at either end are matched first, then lines unique on both sides in their longest common order, then
    what lies between these. A stretch without a unique common line stays unaligned.
    """
    matched = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            matched.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            matched.append((a_hi, b_hi))
        if a_lo < a_hi and b_lo < b_hi:
            anchors = _unique_anchors(a, b, a_lo, a_hi, b_lo, b_hi)
            if anchors:
                matched += anchors
                edges = [(a_lo - 1, b_lo - 1), *anchors, (a_hi, b_hi)]
                todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(matched)


def repeated_places(earlier, later, sizes, block_chars=BLOCK_CHARS):
    """Places in ``later`` of aligned blocks (consecutive on both sides) with enough characters."""
    gone, block = [], []

    def close():
        if sum(sizes[j] for j in block) >= block_chars:
            gone.extend(block)

    last = None
    for i, j in patience(earlier, later):
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            close()
            block = []
        block.append(j)
        last = (i, j)
    close()
    return gone


def with_lines(docs: DataFrame) -> DataFrame:
    """``id, h, lines, sizes`` of every distinct document: hashes of its trimmed lines and their characters."""
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    trimmed = F.transform(split, lambda line: F.trim(F.translate(line, "\r\t", "  ")))
    return (
        docs.select(order_id().alias("id"), row_hash().alias("h"), trimmed.alias("trimmed"))
        .select(
            "id",
            "h",
            F.transform("trimmed", lambda line: F.xxhash64(line)).alias("lines"),
            F.transform("trimmed", lambda line: F.length(line)).alias("sizes"),
        )
        .dropDuplicates(["id", "h"])
    )


def with_turns(lined: DataFrame) -> DataFrame:
    """``lined`` with ``turn``, which orders documents that share an id: by hash, the smallest stands first of all."""
    ids = lined.groupBy("id").agg(F.min("h").alias("smallest"), F.count("*").alias("n")).where("n > 1").drop("n")
    turn = F.when(F.coalesce(F.col("smallest"), F.col("h")) == F.col("h"), F.lit(FIRST_TURN)).otherwise(F.col("h"))
    return lined.join(materialized(ids, "line-ids"), "id", "left").withColumn("turn", turn).drop("smallest")


def line_holders(lined: DataFrame, seed_chars=SEED_CHARS) -> DataFrame:
    """``id, h, turn, line, place, once, first, n``: seed lines that several documents hold, and who holds them.

    ``once`` says that the document has the line at one place only, ``place`` is its first place there, ``first`` is
    the smallest id that holds it.
    """
    placed = F.transform("lines", lambda line, i: F.struct(line.alias("line"), i.alias("place")))
    long_ones = F.filter(placed, lambda x: F.get("sizes", x["place"]) >= seed_chars)
    ordered = lined.select("id", "h", "turn", F.array_sort(long_ones).alias("ordered"))
    marked = F.transform(
        "ordered",
        lambda x, i: F.struct(
            x["line"].alias("line"),
            x["place"].alias("place"),
            (~x["line"].eqNullSafe(F.get("ordered", i + 1)["line"])).alias("once"),
            (~x["line"].eqNullSafe(F.get("ordered", i - 1)["line"])).alias("new"),
        ),
    )
    # The first of equal lines stands for all; it is the only one if it is not followed by another.
    seeds = ordered.select("id", "h", "turn", F.explode(F.filter(marked, lambda x: x["new"])).alias("seed"))
    seeds = seeds.select("id", "h", "turn", "seed.line", "seed.place", "seed.once")
    holders = seeds.groupBy("line").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that both sides of the join are plain exchanges and a very common line can be split.
    holders = materialized(holders, "line-counts")
    held_lines = materialized(seeds.join(holders, "line"), "line-holders")
    discard(lined.sparkSession, holders)
    return held_lines


def _document():
    """What orders documents."""
    return F.struct("id", "turn")


def _first_holder():
    return F.struct(F.col("first").alias("id"), F.lit(FIRST_TURN).alias("turn"))


def overlapping(shared: DataFrame, rare=RARE_DOCUMENTS) -> DataFrame:
    """``id, h, earlier``: documents and the earlier ones they are aligned with first.

    A rare shared line leads to all earlier holders, fewer than ``rare`` of them. A line that more documents share
    leads each to the first holder's id (of documents that share it, to the one that stands for it): one row for each
    line and document, however common the line is.
    """
    to_first = shared.where(_first_holder() < _document()).select("id", "h", _first_holder().alias("earlier"))
    few = shared.where(F.col("n") <= rare)
    to_all = few.select("id", "h", "turn", "line").join(few.select("line", _document().alias("earlier")), "line")
    to_all = to_all.where(F.col("earlier") < _document()).select("id", "h", "earlier")
    return to_first.union(to_all).distinct()


def _still_there(open_lines, gone):
    """Rows of ``open_lines`` whose place is not among those that their document loses by ``gone``."""
    return (
        open_lines.join(gone, ["id", "h"], "left")
        .where(~F.coalesce(F.array_contains("gone", F.col("place")), F.lit(False)))
        .drop("gone")
    )


def deleted_lines(
    docs: DataFrame, seed_chars=SEED_CHARS, rare=RARE_DOCUMENTS, block_chars=BLOCK_CHARS
) -> DataFrame:
    """``id, h, gone``: for documents that lose lines, the places of these lines.

    id is the doc_id (null: the largest number, so last), h a hash of doc_id and text. A seed line that a document has
    once stays only if the alignments with all earlier holders that have it once leave it, too: common lines that the
    first holder leaves are tried against those others in rounds of about 1, 2, 4 ... holders, until the line is gone
    or all were tried. A line found twice on a side cannot anchor an alignment, so it leads to its first holder (to all
    where it is rare) and to no round: a heading that all documents have twice makes one pair a document, not all pairs.
    """
    spark = docs.sparkSession
    alone = materialized(with_lines(docs), "lines")
    lined = materialized(with_turns(alone), "lines")
    discard(spark, alone)
    shared = line_holders(lined, seed_chars)
    earlier = lined.select(_document().alias("earlier"), F.col("lines").alias("earlier_lines"))

    @F.pandas_udf("array<int>")
    def gone(before: pd.Series, after: pd.Series, sizes: pd.Series) -> pd.Series:
        held("lines", dict)  # what an earlier stage kept in this worker goes
        return pd.Series(
            [
                repeated_places(b.tolist(), a.tolist(), s.tolist(), block_chars)
                for b, a, s in zip(before, after, sizes)
            ]
        )

    # Filters on what it returns stay above it: pushed down they would align each pair twice.
    gone = gone.asNondeterministic()

    def places(pairs):
        aligned = pairs.join(lined, ["id", "h"]).join(earlier, "earlier")
        return aligned.select("id", "h", gone("earlier_lines", "lines", "sizes").alias("places")).where(
            F.size("places") > 0
        )

    def merged(found):
        return found.groupBy("id", "h").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("gone")
        )

    # A folder for each round below one: all rounds are read by one scan, so no plan grows with their number.
    folder, rounds = scratch_path(spark, "line-places"), []

    def aligned(pairs):
        found = places(pairs)
        rounds.append(f"{folder}/{len(rounds)}")
        found.write.parquet(rounds[-1])
        return spark.read.schema(found.schema).parquet(rounds[-1])

    found = aligned(overlapping(shared, rare))
    # About 2 ** level of a line's holders have that level.
    draw = F.pmod(F.xxhash64("line", "id", "turn"), F.lit(2**30)) / F.lit(2.0**30)
    level = F.floor(F.log2(F.greatest(F.lit(1.0), F.col("n") * draw))).cast("int")
    common = shared.where(F.col("once") & (F.col("n") > rare)).withColumn("level", level)
    others = materialized(common.select("line", "level", _document().alias("earlier")), "line-levels")
    written = [lined, shared, others]
    last = others.agg(F.max("level")).head()[0]
    open_lines = common.where(_first_holder() < _document()).select("id", "h", "turn", "line", "place")
    for step in range(0 if last is None else last + 1):
        # A line that is open has one place in its document, which earlier rounds left: only the last can have taken it.
        open_lines = materialized(_still_there(open_lines, merged(found)), "line-open")
        written.append(open_lines)
        if open_lines.isEmpty():
            break
        next_ones = others.where(F.col("level") == step).select("line", "earlier")
        pairs = open_lines.join(next_ones, "line").where(F.col("earlier") < _document())
        pairs = materialized(pairs.select("id", "h", "earlier").distinct(), "line-pairs")
        written.append(pairs)
        found = aligned(pairs)
    for table in written:  # what is returned reads the places only
        discard(spark, table)
    return merged(spark.read.schema(found.schema).parquet(*rounds))


def without_repeated_lines(docs: DataFrame, seed_chars=SEED_CHARS, rare=RARE_DOCUMENTS, block_chars=BLOCK_CHARS):
    """``row, cleaned, n_lines, n_gone`` for every row of ``docs``; row holds all its columns.

    A document is later than another if its doc_id is larger; null ids come last. Rows that share a doc_id (or have
    none) but not the text are ordered by a hash of both; rows with equal doc_id and text are one document and get
    equal results. Lines are compared without white space around them; blank lines are never reason enough to delete.
    A null or empty text stays as it is. Other columns may have any name; an empty table gives no rows.
    """
    found = deleted_lines(docs.select("doc_id", "text"), seed_chars, rare, block_chars)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order_id().alias("id"), row_hash().alias("h")
    )
    joined = whole.join(found, ["id", "h"], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        kept = []
        for text, gone in zip(texts, places):
            if text is None:
                kept.append(None)
                continue
            gone = set(gone.tolist())
            kept.append("\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone]))
        return pd.Series(kept, dtype=object)

    changed = F.col("gone").isNotNull()
    text = F.col("row")["text"]
    cut = cut.asNondeterministic()
    return joined.select(
        "row",
        F.when(changed, cut(F.when(changed, text), F.col("gone"))).otherwise(text).alias("cleaned"),
        F.when(text.isNotNull(), F.size(F.split(text, "\n", -1))).otherwise(0).alias("n_lines"),
        F.when(changed, F.size("gone")).otherwise(0).alias("n_gone"),
    )


def with_lines_deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated blocks of lines taken out of text (n_chars follows); emptied documents go."""
    cleaned = without_repeated_lines(docs, **settings)
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    columns = [
        F.when(F.col("n_gone") > 0, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    left = F.col("cleaned").isNull() | (F.col("n_gone") < F.col("n_lines"))
    return cleaned.where(left).select(*columns)
