"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from pyspark.sql import functions as F

from ebbtide.llm import language, line_alignment, mixing, packing, simhash
from ebbtide.session import scratch_path

#: Columns of ``documents``, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs):
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def identify_languages(spark, docs, sf_dir):
    """Keeps the documents whose language can be told; texts that are null or have no letter go.

    The model learns from the labelled documents at hand. Repeated rows stay; an empty table stays empty.
    """
    return language.with_known_language(_documents(docs))


def deduplicate_lines(spark, docs, sf_dir):
    """Blocks of lines that an earlier document has, too, are cut from the text, and n_chars with it.

    Documents that lose all their lines go. Null texts stay as they are.
    """
    return line_alignment.with_lines_deduplicated(_documents(docs))


def deduplicate_documents(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays.

    It is the one with the smallest doc_id; repeated rows are duplicates, too. Null texts count as empty ones.
    """
    return simhash.without_near_duplicates(_documents(docs))


def mix_sources(spark, docs, sf_dir):
    """Every document as often as its source's target asks for; documents taken twice are there twice."""
    return mixing.emit(_documents(docs))


def pack_sequences(spark, docs, sf_dir):
    """Where each piece of each document lies in the training sequences."""
    return packing.packed(_documents(docs))


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", deduplicate_lines),
    ("SimHash near-dedup", deduplicate_documents),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A learned model and a tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order, from ``documents`` to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
