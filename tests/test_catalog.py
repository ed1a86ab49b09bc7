"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from turnwise.plans import catalog


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v) if not hasattr(v, "item") else cell(v.item())

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))


def numbers(row: tuple) -> list:
    """Cells that are numbers as such, so that 1 and 1.0 are equal."""
    out = []
    for x in row:
        try:
            out.append(float(x))
        except ValueError:
            out.append(x)
    return out


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


#: held against brute force elsewhere, as SQL cannot express them
WITHOUT_SQL = {"density_clusters", "wer_pairs"}


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    ours = catalog.QUERIES[name](spark, sf).toPandas()
    theirs = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = normal(ours), normal(theirs)
    assert sorted(map(str, map(numbers, a))) == sorted(map(str, map(numbers, b)))
