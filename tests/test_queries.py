"""Each base query against its SQL twin at the smallest scale."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from simjoin.oracles import ORACLES
from simjoin.queries import QUERIES

DATA = os.environ.get("SIMJOIN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, found = QUERIES[name](spark, DATA), duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in got.collect()) == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_hilbert_values(spark):
    """The indices lead back to the coordinates that Z-values are made of, and differ for different coordinates."""
    pick = lambda name: {(r.vec_id, r["shift"]): r for r in QUERIES[name](spark, DATA).where("shift < 2").collect()}
    z, h = pick("zorder_values"), pick("hilbert_values")
    assert {k: r.coords_md5 for k, r in z.items()} == {k: r.coords_md5 for k, r in h.items()}
    assert len({(r["shift"], r.index_md5) for r in h.values()}) == len({(r["shift"], r.coords_md5) for r in h.values()})
