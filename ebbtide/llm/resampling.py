"""Importance resampling towards a target collection by hashed word runs.

A text's separators are collapsed to single spaces; an overlapped regular expression with boundary look-arounds then
emits the span of every run of 1 to n words, and a span's bytes are counted under their CRC-32 modulo the number of
buckets. Buckets that are more frequent in the target than in the corpus gain; a document's weight is the sum of its
features' gains, and seeded Gumbel noise turns the highest scores into a draw without replacement.
"""

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.tables import with_size_checked
from ebbtide.llm.text import text_bytes
from ebbtide.session import materialized

LONGEST_RUN = 1
BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = 2024
#: Rows that one task numbers, on average.
RANKED_ROWS = 200_000
#: Spans whose bucket or gain a worker remembers.
KNOWN_SPANS = 300_000

# A word has ASCII letters, digits and anything beyond ASCII; the other 66 ASCII characters separate.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def spans_pattern(n):
    """Matches every run of ``n`` words of a collapsed text when it is scanned with overlaps."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapsed(text: bytes) -> bytes:
    """Lower-case A-Z, words with one space between them."""
    return b" ".join(text.lower().translate(_TO_SPACE).split())


class _Known(dict):
    """Span to its bucket, or to what a table holds for that bucket."""

    def __init__(self, buckets, values=None):
        super().__init__()
        self.buckets, self.values = buckets, values

    def __missing__(self, span):
        if len(self) >= KNOWN_SPANS:
            self.clear()
        bucket = zlib.crc32(span) % self.buckets
        self[span] = found = bucket if self.values is None else self.values[bucket]
        return found


def _spans(text, patterns):
    """Spans of each run length of a text given as UTF-8 bytes."""
    words = collapsed(text)
    return [[m.group() for m in p.finditer(words, overlapped=True)] for p in patterns]


def bucket_counts(docs: DataFrame, longest=LONGEST_RUN, buckets=BUCKETS) -> DataFrame:
    """``bucket, n``: features of all whole texts by bucket; at most ``buckets`` rows. A null text has none.

    Each task adds its texts up in one array, so the shuffle holds a row for each task and bucket.
    """

    def count(batches):
        patterns = [spans_pattern(n + 1) for n in range(longest)]
        bucket_of, total = _Known(buckets).__getitem__, np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for spans in _spans(text.as_py(), patterns):
                    if spans:
                        total += np.bincount(np.fromiter(map(bucket_of, spans), np.int64, len(spans)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select(text_bytes().alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest=LONGEST_RUN, buckets=BUCKETS) -> np.ndarray:
    """Gain of every bucket: floor(1000 ln of the target's share over the corpus's share), one added to each count."""
    found = []
    for table in (docs, target):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, longest, buckets).collect():  # at most ``buckets`` rows
            counts[r["bucket"]] = r["n"]
        found.append(counts)
    corpus, wanted = found
    odds = (wanted + 1.0) * float(corpus.sum() + buckets) / ((corpus + 1.0) * float(wanted.sum() + buckets))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def _noise(seed):
    """Gumbel noise times 1000, a whole number, from a hash of the doc_id; a null doc_id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gains, longest=LONGEST_RUN, seed=SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    buckets, values = len(gains), gains.tolist()
    known = {}

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(texts: pa.Array) -> pa.Array:
        if not known:  # once for each task
            known.update(gain=_Known(buckets, values), patterns=[spans_pattern(n + 1) for n in range(longest)])
        gain_of = known["gain"].__getitem__
        rows = np.zeros((3, len(texts)), np.int64)
        for i, text in enumerate(texts):
            spans = _spans(text.as_py(), known["patterns"])
            rows[:, i] = len(spans[0]), sum(map(len, spans)), sum(sum(map(gain_of, s)) for s in spans)
        return pa.StructArray.from_arrays([pa.array(r) for r in rows], ["n_words", "n_features", "weight"])

    found = docs.select("doc_id", weigh(text_bytes()).alias("found")).select("doc_id", "found.*")
    return found.withColumn("score", F.col("weight") + _noise(seed))


def _numbered(rows: DataFrame, order) -> DataFrame:
    """``rows`` in the given order with ``part`` and ``nth`` (from 1 in each part), written once."""
    n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANKED_ROWS)
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], [*batch.schema.names, "part", "nth"])
            seen += n

    dealt = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return materialized(dealt.mapInArrow(number, f"{schema}, part int, nth long"), "ranks")


def resampled(docs: DataFrame, target: DataFrame, longest=LONGEST_RUN, buckets=BUCKETS, least_words=LEAST_WORDS,
              percent=DRAWN_PERCENT, seed=SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``, drawn towards the texts of ``target``.

    Of the documents with ``least_words`` or more, the floor of ``percent`` in a hundred with the highest scores are
    drawn and numbered from 1, ties to the smaller doc_id (null last); all others have a null rank. Reads ``doc_id,
    text`` of ``docs`` and ``text`` of ``target``; other columns may have any name. A null text is empty; a text
    without words has weight 0. Repeated rows each count; rows that agree in doc_id and score are interchangeable.
    An empty ``docs`` gives no rows, an empty ``target`` is one in which no bucket occurs.

    Two passes read the texts; what is ranked are narrow rows, dealt by ranges of the score, so no task sees all of
    them and nothing but the bucket counts reaches the driver.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    rows = materialized(scored(docs, gains, longest, seed), "scores")
    fields = ["doc_id", "n_features", "weight", "score"]
    may_go = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight")]
    numbered = _numbered(rows.where(may_go).select(*fields), order)
    # One row for each part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    n_drawn = numbered.count() * percent // 100
    rank = F.col("before") + F.col("nth")
    ranked = numbered.join(with_size_checked(sizes), "part").select(*fields, F.when(rank <= n_drawn, rank).alias("rank"))
    return ranked.unionByName(rows.where(~may_go).select(*fields, F.lit(None).cast("long").alias("rank")))
