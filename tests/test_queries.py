"""Every registered query of the core against its SQL on the smallest data."""

import glob
import importlib
import os

import pytest

from driftmark import plans

DATA = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"driftmark.plans.{m}") for m in plans.MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def text(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in SQL:
        assert got, "tested by brute force elsewhere; here only that there are rows"
        return
    res = duck.execute(SQL[name])
    cols = [x[0] for x in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert got == sorted(tuple(text(r[i]) for i in order) for r in res.fetchall())
