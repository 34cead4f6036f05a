"""Session set-up and the shared folder for intermediate tables."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores="*", partitions=8, app="ebbtide"):
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A driver-side list of a few tuples as a local table: no Python worker, and its size is known."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def plain(value, kind):
        if value is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: plain(v, f.dataType) for f, v in zip(kind, value)}
        if isinstance(kind, T.ArrayType):
            return [plain(v, kind.elementType) for v in value]
        return value

    table = pa.Table.from_pylist([plain(tuple(r), fields) for r in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, fields)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or a local one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
    own = tempfile.mkdtemp(prefix="ebbtide-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir("file://" + own)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/ebbtide/{label}-{uuid.uuid4().hex}"


#: Rows of long texts or lists that a Python worker is handed at a time.
FEW_ROWS = 1_000


@contextmanager
def worker_batches(spark: SparkSession, rows):
    """What is run meanwhile hands Python workers at most ``rows`` rows at a time (None: as many as the session says)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialized(df: DataFrame, label: str, batch_rows=None) -> DataFrame:
    """``df`` written once as a columnar table in the shared folder and read back.

    Later passes read fixed rows and only the columns they need, survive lost executors, and their plans no
    longer carry everything that led to the table. ``batch_rows`` bounds the batches of its Python workers.
    """
    path = scratch_path(df.sparkSession, label)
    with worker_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
