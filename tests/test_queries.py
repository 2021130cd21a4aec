"""Every query against its SQL, and the same answer however the input is partitioned."""

import glob
import os

import duckdb
import pytest

from codicil.plans.registry import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    return str(round(float(x), 6)) if isinstance(x, (int, float)) else str(x)


def rows_of(rows):
    return sorted(tuple(plain(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.select(*columns).collect()) == rows_of(want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
