"""Customer tables in, scored tables out."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators.scoring import scored_records


class TableNotFoundError(FileNotFoundError):
    """There is no customer table at the given path."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value to Spark (and larger than every number), so it is turned into NULL at the source."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _typed(column, kind):
    value = F.col(f"`{column}`")
    if kind.typeName() == "integer":
        value = value.try_cast("double")  # whole numbers may be written as 5.0
    return value.try_cast(kind).alias(column)


def read_customers(spark: SparkSession, path, file_format=None, schema=S.CUSTOMER_SCHEMA, typed=True) -> DataFrame:
    """Read a customer table without cleaning it. CSV uses the declared schema; other formats bring their own.

    ``typed=False`` leaves CSV columns as text, so that quality counts can tell unparsable from missing.
    """
    kind = file_format or ("csv" if str(path).rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.format(kind)
    if kind == "csv":
        # Columns are taken by header name: inference is off, so every column first arrives as text.
        reader = reader.option("header", True)
    elif kind == "json":
        reader = reader.schema(schema)
    try:
        raw = reader.load(str(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise TableNotFoundError(f"no customer table at {path}") from error
        raise
    if kind == "csv" and typed:
        types = {f.name: f.dataType for f in schema}
        raw = raw.select(*[_typed(c, types[c]) if c in types else F.col(f"`{c}`") for c in raw.columns])
    return nan_to_null(raw)


def write_scored(scored: DataFrame, path, file_format="parquet") -> None:
    writer = scored_records(scored).write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.save(str(path))


def read_scored(spark: SparkSession, path, file_format="parquet") -> DataFrame:
    reader = spark.read.format(file_format).schema(S.SCORED_SCHEMA)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.load(str(path))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint in one pass.

    The exclusive-or alone would cancel duplicated pairs of rows, so a sum of hashes and the count go with it.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("row_count"),
        F.bit_xor(row_hash).alias("hash_xor"),
        F.sum(F.pmod(row_hash, F.lit(2**31))).alias("hash_sum"),
    )
