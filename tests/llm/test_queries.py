"""Corpus queries that have SQL, compared with DuckDB."""

import duckdb
import pytest

from ebbtide.llm import queries

from .conftest import FOLDER


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    relation = duck.sql(queries.CHECKS[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in places) for r in relation.fetchall()), key=repr)
