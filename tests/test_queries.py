"""Every registered query against its SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(df):
    def value(x):
        if x is None or not hasattr(x, "__len__") and pd.isna(x):
            return None
        return x if isinstance(x, (bool, str)) else float(x) if isinstance(x, float) else int(x) if hasattr(x, "__index__") else str(x)

    return sorted(repr(tuple(map(value, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, duck, name):
    got, want = driver.queries()[name](spark, SF).toPandas(), duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_rows_only_queries(spark):
    for name in sorted(set(driver.queries()) - set(driver.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            assert driver.queries()[name](spark, SF).count() > 0, name
