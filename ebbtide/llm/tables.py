"""Small tables next to large ones, and tables that loops write and give up again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import materialized

#: Rows up to which a table of short rows is sent to every executor; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000


def with_size_checked(table: DataFrame, limit=BROADCAST_ROWS) -> DataFrame:
    """``table`` written once; marked for broadcast only if it was counted to have few rows."""
    written = materialized(table, "lookup")
    return F.broadcast(written) if written.count() <= limit else written


def discard(spark, table: DataFrame) -> None:
    """Remove the files of a table that ``materialized`` wrote and that nothing reads any more."""
    jvm = spark._jvm
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
