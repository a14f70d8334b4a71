import os

import duckdb
import pandas as pd
import pytest

from reachforge.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return f"{v:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    a, b = QUERIES[name](spark, D).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    for c in cols:  # the same instants, whatever type pandas gives them
        if "date" in str(b[c].dtype) or "date" in str(a[c].dtype):
            a[c], b[c] = a[c].astype("datetime64[us]").astype(str), b[c].astype("datetime64[us]").astype(str)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
