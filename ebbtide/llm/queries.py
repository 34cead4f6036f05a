"""The corpus queries that are registered, one for each operator, over whole tables."""

from pyspark.sql import functions as F

from ebbtide.llm import (
    checks,
    fertility,
    language,
    line_alignment,
    mixing,
    packing,
    prefix_trie,
    resampling,
    sentence_spans,
    simhash,
    style_tree,
    token_counts,
    token_files,
    version_sketch,
)

QUERIES = {}
CHECKS = {}


def query(name, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_token_counts")
def op1_token_counts(spark, folder):
    return token_counts.with_suffix_sums(token_counts.length_histogram(documents(spark, folder)))


@query("op2_simhash_pivots")
def op2_simhash_pivots(spark, folder):
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op3_line_alignment")
def op3_line_alignment(spark, folder):
    found = line_alignment.without_repeated_lines(documents(spark, folder))
    return found.select("row.doc_id", "n_lines", "n_gone", F.col("cleaned").alias("text"))


@query("op4_language_pieces")
def op4_language_pieces(spark, folder):
    return language.predicted_languages(documents(spark, folder))


@query("op5_source_mix")
def op5_source_mix(spark, folder):
    return mixing.mixed(documents(spark, folder)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("n_copies")).alias("taken"),
        "source",
        "rate",
        "n_copies",
    )


@query("op6_token_fertility")
def op6_token_fertility(spark, folder):
    return fertility.quality_verdicts(documents(spark, folder))


@query("op7_version_sketch")
def op7_version_sketch(spark, folder):
    return version_sketch.fingerprinted(documents(spark, folder))


@query("op8_sentence_spans")
def op8_sentence_spans(spark, folder):
    found = sentence_spans.without_repeated_spans(documents(spark, folder))
    return found.select(
        "row.doc_id", F.size("removed").alias("n_removed"), "removed", F.col("cleaned").alias("text")
    )


@query("op9_token_blocks")
def op9_token_blocks(spark, folder):
    return token_files.round_trip(documents(spark, folder))


@query("op10_pattern_packing")
def op10_pattern_packing(spark, folder):
    return packing.packed(documents(spark, folder))


@query("op11_prefix_trie", checks.PREFIX_TRIE)
def op11_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op12_overlapped_resampling", checks.RESAMPLED)
def op12_overlapped_resampling(spark, folder):
    return resampling.resampled(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op13_style_tree")
def op13_style_tree(spark, folder):
    return style_tree.extracted(spark.read.parquet(f"{folder}/pages.parquet"))
