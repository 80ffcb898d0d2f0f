"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from moraine.plans import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "-"
    if isinstance(x, bool | str):
        return str(x)
    if isinstance(x, int | float):
        return repr(float(x))
    return x.isoformat()[:19] if hasattr(x, "isoformat") else str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
