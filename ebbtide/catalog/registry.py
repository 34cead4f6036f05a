"""Registration of queries with the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name, sql=None):
    """Register a query; ``sql`` is what an independent engine must return on the same tables."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Doubles rounded, so that two engines that add in a different order can be compared."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def r6(expression, name=None):
    """SQL for a rounded double."""
    alias = f" AS {name}" if name else ""
    return f"CAST(round({expression}, 6) AS DOUBLE) + CAST(0 AS DOUBLE){alias}"
