"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A sketch has three rows of cells. Every paragraph digest goes into one cell of each row; a cell keeps how many digests
it holds, their exclusive or and that of their check hashes. Cells of two versions subtract, which leaves the digests
of paragraphs that only one of them has. Peeling recovers them: a cell with one digest names it, and taking it out of
its other cells frees more. If cells remain, the sketches were too small and the pair is tried again with larger ones.

Everything is built of DataFrame functions: digests are exploded into rows of cells, and all passes after the one
exchange by document group within partitions.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.tables import discard
from ebbtide.llm.text import order_id, row_hash
from ebbtide.session import materialized

#: Cells in each of the three rows of a published sketch, and how much longer the rows get with every retry.
WIDTH = 8
GROWTH = 8
#: Peeling passes over the three rows before a pair counts as failed, and retries before giving up.
PASSES = 3
RETRIES = 12

KEY = ["id", "h"]


def paragraph_digests(text):
    """Digests of the distinct lines of a text."""
    return F.array_distinct(F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(line)))


def _check(digest):
    return F.xxhash64(digest, F.lit("check"))


def _cells_of(digest, width):
    """Places of a digest in the three rows; sketches of another width use other hashes."""
    spread = F.xxhash64(digest, F.lit(width))
    return [
        (F.pmod(F.shiftright(spread, 20 * row), F.lit(width)) + row * width).cast("int") for row in range(3)
    ]


def sketch_cells(digests: DataFrame, by, width) -> DataFrame:
    """Cells ``n, digest, check`` of the digests (columns ``by``, digest, sign): grouped by ``by`` and cell."""
    entries = digests.select(*by, "sign", "digest", F.explode(F.array(*_cells_of(F.col("digest"), width))).alias("cell"))
    return entries.groupBy(*by, "cell").agg(
        F.sum("sign").alias("n"),
        F.bit_xor("digest").alias("digest"),
        F.bit_xor(_check(F.col("digest"))).alias("check"),
    )


def peeled(cells: DataFrame, by, width, passes=PASSES) -> DataFrame:
    """``by, differing, failed``: how many digests were recovered, and whether cells remain.

    The rows of cells take turns: within one row a digest has one cell, so it is never taken out twice.
    """
    counter = F.lit(-1)
    for _ in range(passes):
        for row in range(3):
            mine = F.col("cell").between(row * width, (row + 1) * width - 1)
            pure = mine & (F.abs("n") == 1) & (F.col("check") == _check(F.col("digest")))
            places = _cells_of(F.col("digest"), width)
            out = [
                F.struct(places[r].alias("cell"), (-F.col("n")).alias("n"), F.col("digest"), F.col("check"))
                for r in range(3)
                if r != row
            ]
            found = F.struct(
                counter.alias("cell"),
                F.lit(1).cast("long").alias("n"),
                F.lit(0).cast("long").alias("digest"),
                F.lit(0).cast("long").alias("check"),
            )
            same = F.struct("cell", "n", "digest", "check")
            cells = (
                cells.select(*by, F.inline(F.when(pure, F.array(*out, found)).otherwise(F.array(same))))
                .groupBy(*by, "cell")
                .agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
                .where("n <> 0 or digest <> 0 or check <> 0")
            )
    return cells.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("cell") == counter, F.col("n"))), F.lit(0)).alias("differing"),
        F.max(F.col("cell") != counter).alias("failed"),
    )


def sketch_text(cells: DataFrame, by) -> DataFrame:
    """``by, sketch``: the cells that hold something as text, in order: place, count, digest and check in hex."""
    cell = F.concat_ws(
        ".",
        F.col("cell").cast("string"),
        F.col("n").cast("string"),
        F.lower(F.lpad(F.hex("digest"), 16, "0")),
        F.lower(F.lpad(F.hex("check"), 16, "0")),
    )
    return cells.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", cell.alias("t")))), lambda x: x["t"]), ";").alias(
            "sketch"
        )
    )


def differences(versions: DataFrame, width=WIDTH) -> DataFrame:
    """``id, h, pair, differing`` of pairs of versions: how many digests only one of the two has.

    ``versions`` has ``id, h`` and, in ``pairs``, an array of structs (pair, left, right) with the digests of both.
    Pairs whose sketches do not peel are tried again with longer rows and other hashes, and only those.
    """
    spark = versions.sparkSession
    by = [*KEY, "pair"]
    todo = materialized(versions.select(*KEY, F.inline("pairs")), "sketch-pairs")
    done = None
    for _ in range(RETRIES):
        sides = F.array(
            F.struct(F.lit(1).cast("long").alias("sign"), F.col("left").alias("digests")),
            F.struct(F.lit(-1).cast("long").alias("sign"), F.col("right").alias("digests")),
        )
        digests = (
            todo.repartition(*KEY)
            .select(*by, F.inline(sides))
            .select(*by, "sign", F.explode("digests").alias("digest"))
        )
        tried = materialized(peeled(sketch_cells(digests, by, width), by, width), "sketch-peeled")
        # Pairs without any cell left, and so without a row, agree in all digests.
        good = todo.select(*by).join(tried, by, "left").where(~F.coalesce("failed", F.lit(False)))
        good = good.select(*by, F.coalesce("differing", F.lit(0)).alias("differing"))
        good = materialized(good, "sketch-good")
        done = good if done is None else done.union(good)
        failed = materialized(todo.join(tried.where("failed").select(*by), by), "sketch-pairs")
        discard(spark, todo)
        discard(spark, tried)
        todo = failed
        width *= GROWTH
        if todo.isEmpty():
            return done
    raise RuntimeError("sketches did not peel")


def likeness(left, right, differing):
    """Shared digests over all digests of two versions."""
    both = F.size(left) + F.size(right)
    return (both - differing) / (both + differing)


def in_ring(docs: DataFrame) -> DataFrame:
    """``id, h, doc_id, n_chars, prev_id, prev_h, prev_chars``: each document and the one before it, in a ring.

    Order is by doc_id (null last), ties by a hash of doc_id and text; rows equal in both are one document. Rows are
    dealt by ranges; only the last row of every range is looked at from outside it.
    """
    narrow = docs.select(order_id().alias("id"), row_hash().alias("h"), "doc_id", F.length("text").alias("n_chars"))
    narrow = narrow.withColumn("n_chars", F.coalesce("n_chars", F.lit(0)).cast("long")).dropDuplicates(KEY)
    dealt = materialized(narrow.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "ring")
    within = Window.partitionBy("part").orderBy(*KEY)
    # One row for each range.
    lasts = dealt.groupBy("part").agg(F.max(F.struct(*KEY, "n_chars")).alias("last"))
    ordered = Window.orderBy("part")
    lasts = lasts.select(
        "part",
        F.coalesce(F.lag("last").over(ordered), F.max("last").over(Window.partitionBy(F.lit(0)))).alias("before"),
    )
    here = F.lag(F.struct(*KEY, "n_chars")).over(within)
    return (
        dealt.withColumn("here", here)
        .join(lasts, "part")
        .withColumn("prev", F.coalesce("here", "before"))
        .select(
            *KEY,
            "doc_id",
            "n_chars",
            F.col("prev.id").alias("prev_id"),
            F.col("prev.h").alias("prev_h"),
            F.col("prev.n_chars").alias("prev_chars"),
        )
    )


def edited_versions(docs: DataFrame) -> DataFrame:
    """``id, h, doc_id, n_chars, edited_sha256, own, edited, next`` (the last three are digests), a row for each row.

    The edited text has the last quarter of its characters replaced by as many from the start of the next document.
    Texts move once, by document; a document sends only the piece and the digests that the one before it needs.
    """
    ring = materialized(in_ring(docs), "ring")
    texts = docs.select(order_id().alias("id"), row_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    sent = (
        texts.join(ring.drop("doc_id", "n_chars"), KEY)
        .select(
            F.col("prev_id").alias("id"),
            F.col("prev_h").alias("h"),
            F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("piece"),
            paragraph_digests(F.col("text")).alias("next"),
        )
        .groupBy(*KEY)
        .agg(F.first("piece").alias("piece"), F.first("next").alias("next"))
    )
    quarter = F.floor(F.col("n_chars") / 4)
    own = texts.join(ring.select(*KEY, "doc_id", "n_chars"), KEY).join(sent, KEY)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.col("piece"))
    return own.withColumn("edited_text", edited).select(
        *KEY,
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited_text")).alias("edited"),
        "next",
    )


def fingerprinted(docs: DataFrame, width=WIDTH) -> DataFrame:
    """Fingerprints of every text of ``doc_id, text`` and of its edited version, and how alike they are.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A
    fingerprint is a sketch of the distinct lines; likeness is shared over all lines, from the peeled difference. A
    null text is empty (one empty line). Repeated rows are one document and give equal rows; rows that share a doc_id
    but not the text follow each other. A single document is its own next. An empty table gives no rows; other
    columns are not read.
    """
    rows = materialized(edited_versions(docs), "versions")
    versions = rows.dropDuplicates(KEY)
    pair = lambda name, right: F.struct(F.lit(name).alias("pair"), F.col("own").alias("left"), F.col(right).alias("right"))
    found = differences(
        versions.select(*KEY, F.array(pair("edited", "edited"), pair("next", "next")).alias("pairs")), width
    )
    apart = found.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("pair") == p, F.col("differing"))).alias(f"{p}_differing") for p in ("edited", "next")]
    )
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("digests"))
    digests = (
        versions.repartition(*KEY)
        .select(*KEY, F.inline(F.array(side("own"), side("edited"))))
        .select(*KEY, "side", F.lit(1).cast("long").alias("sign"), F.explode("digests").alias("digest"))
    )
    texts = sketch_text(sketch_cells(digests, [*KEY, "side"], width), [*KEY, "side"])
    prints = texts.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("side") == s, F.col("sketch"))).alias(f"{s}_sketch") for s in ("own", "edited")]
    )
    return (
        rows.join(apart, KEY)
        .join(prints, KEY)
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.col("own_sketch").alias("fingerprint"),
            F.col("edited_sketch").alias("edited_fingerprint"),
            likeness("own", "edited", F.col("edited_differing")).alias("near_edited"),
            likeness("own", "next", F.col("next_differing")).alias("near_next"),
        )
    )
