"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from siltworks.plans import catalog


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return con


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v) if isinstance(v, str) or not hasattr(v, "__int__") else str(int(v))

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, tiny, name):
    a = catalog.QUERIES[name](spark, tiny).toPandas()
    b = duck.execute(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, tiny, name):
    assert catalog.QUERIES[name](spark, tiny).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
