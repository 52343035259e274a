"""Every registered query of the library that has SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from wayspan.plans import access, candidates, controls, feeds, network, reviews, storage, surfaces, zonal

PLANS = (access, surfaces, reviews, feeds, zonal, candidates, network, storage, controls)
ALL = {k: v for plan in PLANS for k, v in plan.QUERIES.items()}
SQL = {k: v for plan in PLANS for k, v in plan.SQL.items()}


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, map(plain, r))) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, duck, name):
    got = ALL[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0
