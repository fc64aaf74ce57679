"""Every core query runs over whole tables, and agrees with its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from kinmatch.plans import catalogue


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "__float__") and not isinstance(v, str):
        return f"{float(v):.5f}"
    return str(v)


@pytest.fixture(scope="module")
def db(small):
    import os

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, db, name):
    got = catalogue.queries()[name](spark, small)
    cols = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        cur = db.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert mine == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
