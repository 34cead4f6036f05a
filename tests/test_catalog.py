"""Every registered query with check SQL, compared with DuckDB on the driver's smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from ebbtide import catalog

FOLDER = Path("/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

needs_data = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, str(FOLDER))
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    relation = duck.sql(catalog.CHECKS[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    places = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in relation.fetchall()), key=repr)
    spark.catalog.clearCache()
    assert got == want


def test_entry_points_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalog.QUERIES) <= set(entry_points.queries())


@needs_data
@pytest.mark.parametrize(
    "name", ["p12_feature_vector", "r3_shuffled_folds", "s5_table_fingerprint", "s9_smoke_sample", "v1_column_contract"]
)
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, str(FOLDER)).count() > 0
