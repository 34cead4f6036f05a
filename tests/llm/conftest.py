import pandas as pd
import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

# Columns an operator makes itself come in with other contents; they must neither break it nor leak into its result.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("id", "h", "fp", "row", "rank", "size", "length", "kept", "gone")],
    ]
)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * 9)


PROSE = "The cat sat on the mat and looked at the moon for a long while. Then it went home to sleep by the fire."
ODD = [
    row(1, PROSE),
    row(2, None),
    row(3, ""),
    row(4, " \n\t "),
    row(5, PROSE),  # a copy
    row(6, PROSE + "\n" + "A second line that is long enough to count as one."),
    row(7, "word " * 30_000),  # very long, one word
    row(8, "x" * 20_000),  # very long without white space
    row(9, "1234 !!! ###", None, None),
    row(10, "one", None, "b"),
    row(10, "one", None, "b"),  # a repeated row
    row(10, "a different text under the same doc_id", "de", "b"),
    row(None, "A text without an id, which is long enough for a line.", "en", None),
    row(None, "A text without an id, which is long enough for a line.", "en", None),
    row(11, "A text without an id, which is long enough for a line.", "en", "\U0001f600"),
    row(12, "Ünï cödé 日本語 テキスト and \U0001f600 <|endoftext|> <|ENDOFTEXT|> don't", "fr", "é"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, copies, repeated rows, shared and missing ids, clashing columns."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def rows():
    """The same documents as pandas rows in doc_id order."""
    return pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def words(text):
    return (text or "").encode().split()
