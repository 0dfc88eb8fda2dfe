"""Queries with SQL give the same rows in Spark and DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from twinpath.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.queries()[name](spark, tables)
    columns = sorted(df.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert sorted(found, key=repr) == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall()), key=repr)
