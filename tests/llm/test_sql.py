"""Operators that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from turnwise.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    theirs = con.sql(queries.ORACLE_SQL[name])
    ours = queries.QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(theirs.select(*columns).fetchall())
