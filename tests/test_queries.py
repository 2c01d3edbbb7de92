"""Every registered query that SQL can state, against DuckDB at the smallest scale."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cells(df):
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.5g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")
@pytest.mark.parametrize("name", sorted(entry.queries().keys() - {"pipeline"}))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
