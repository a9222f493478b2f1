"""Every query with SQL gives what the SQL gives in DuckDB; every other one runs and has rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sealwright.plans import queries as p

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(p.QUERIES))
def test_query(spark, con, name):
    got = p.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in p.ORACLE_SQL:
        want = con.sql(p.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_chain_heads_gather_no_log(spark):
    """A user may have any share of the events, so no row may hold a whole log."""
    plan = p.QUERIES["seal_chain_heads"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
