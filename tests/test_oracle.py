"""Every query that SQL can express gives the same rows as DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "-"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    mine, theirs = entry.queries()[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).columns
