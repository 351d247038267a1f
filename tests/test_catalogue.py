"""Queries against their SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from wayfare.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows(frame, columns):
    """Values without the types that each engine's frames give them."""

    def plain(v):
        if v is None or pd.isna(v):
            return None
        return v.item() if hasattr(v, "item") else v

    return [tuple(plain(v) + 0 if isinstance(plain(v), float) else plain(v) for v in r) for r in frame[columns].itertuples(index=False)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = repr
    assert sorted(rows(got, columns), key=key) == sorted(rows(want, columns), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
