"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quarry.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(frame):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        try:
            return f"{float(v):.4f}" if not isinstance(v, str) else v
        except TypeError:
            return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_validity_of_numbers_that_look_like_years(spark, tmp_path):
    orders = pd.DataFrame({"o_orderkey": range(1, 1201), "o_custkey": [1940 + k % 105 for k in range(1200)]})
    orders.to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet')")
    assert plain(QUERIES["validity_of_acts"](spark, str(tmp_path)).toPandas()) == plain(con.execute(ORACLES["validity_of_acts"]).df())
