"""Every query of the catalog against its SQL in DuckDB on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
PYTHON = ("BB02",)  # tested on rows by hand in test_sources.py
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return int(v) if isinstance(v, bool) else str(v) if v is not None and not isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in PYTHON:
        assert got
        return
    res = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
