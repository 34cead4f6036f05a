"""Exact length histogram: documents by encoded length, with suffix sums for every context limit."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.text import vocabulary, whole_text, word_encoder
from ebbtide.session import materialized

#: Lengths whose suffix sums one task adds up; sums of whole blocks come first.
BLOCK = 1024


def token_length(column, path=None):
    """Number of ids of each whole text (a column without nulls)."""
    path = path or vocabulary("word_bpe_49k.json")

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        counted = [np.diff(ends, prepend=0) for _, _, ends in word_encoder(path).encode_all(texts)]
        return pa.array(np.concatenate(counted) if counted else [], pa.int64())

    return lengths(column)


def length_histogram(docs: DataFrame, path=None) -> DataFrame:
    """Rows ``length, documents``: how many texts have exactly that many ids.

    Null and empty texts have length 0; every row counts, repeated ones too. Only the text is read, so other
    columns may have any name. An empty table gives an empty histogram.
    """
    return (
        docs.select(token_length(whole_text(), path).alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("documents"))
    )


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Suffix sums of a histogram, so that one row answers for the context limit equal to its length.

    documents_at_least, tokens_at_least: texts of that length or more, and their ids;
    tokens_truncated: all ids left when every text is cut to that length; share_at_most: share of the texts that
    fit whole. Lengths are summed in blocks, and blocks before each other, so no task sees all lengths.
    """
    counted = materialized(histogram, "lengths").withColumn("block", F.expr(f"length div {BLOCK}"))
    tokens = F.col("length") * F.col("documents")
    blocks = counted.groupBy("block").agg(F.sum("documents").alias("d"), F.sum(tokens).alias("t"))
    # One row for each block of lengths: as many as the longest text has blocks.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    at_least = F.col("d_later") + F.sum("documents").over(within)
    tokens_at_least = F.col("t_later") + F.sum(tokens).over(within)
    return (
        counted.join(blocks, "block")
        .withColumns({"documents_at_least": at_least, "tokens_at_least": tokens_at_least})
        .select(
            "length",
            "documents",
            "documents_at_least",
            "tokens_at_least",
            (F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("documents_at_least")).alias(
                "tokens_truncated"
            ),
            ((F.col("d_all") - F.col("documents_at_least") + F.col("documents")) / F.col("d_all")).alias(
                "share_at_most"
            ),
        )
    )


def at_limits(sums: DataFrame, limits) -> DataFrame:
    """What every limit of a short list keeps: ``context_limit, documents_cut, tokens_truncated``.

    ``sums`` is the result of ``with_suffix_sums``. Limits need not be lengths that occur: the row of the next
    longer length holds the same suffix, and a limit beyond all texts cuts none.
    """
    total = F.sum(F.col("length") * F.col("documents"))
    answers = []
    for limit in limits:
        longer = F.col("length") > limit
        suffix = F.min_by(
            F.struct("documents_at_least", "tokens_at_least"), F.when(longer, F.col("length"))
        )
        cut = F.coalesce(suffix["documents_at_least"], F.lit(0))
        lost = F.coalesce(suffix["tokens_at_least"], F.lit(0)) - cut * limit
        answers.append(
            F.struct(
                F.lit(limit).cast("long").alias("context_limit"),
                cut.alias("documents_cut"),
                (F.coalesce(total, F.lit(0)) - lost).alias("tokens_truncated"),
            )
        )
    return sums.agg(F.array(*answers).alias("answers")).select(F.inline("answers"))


def length_quantiles(sums: DataFrame, shares) -> DataFrame:
    """Smallest length that at least a given share of the texts does not exceed: ``share, length``.

    Null for an empty table.
    """
    return sums.agg(
        F.array(
            *[
                F.struct(
                    F.lit(float(q)).alias("share"),
                    F.min(F.when(F.col("share_at_most") >= q, F.col("length"))).alias("length"),
                )
                for q in shares
            ]
        ).alias("answers")
    ).select(F.inline("answers"))
