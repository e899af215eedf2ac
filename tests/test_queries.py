"""Every query of the library with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from tidepanel.plans.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if v is None else "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in ORACLES:
        return
    said = duck.sql(ORACLES[name])
    assert sorted(said.columns) == sorted(out.columns)
    order = sorted(out.columns)
    at = [list(said.columns).index(c) for c in order]
    mine = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in said.fetchall())
    assert mine == theirs


def test_prefix_invariance(spark):
    assert QUERIES["dq_09_prefix_invariance"](spark, SF).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
