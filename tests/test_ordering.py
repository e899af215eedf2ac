"""Places and ranks over all rows against plain Python."""

from __future__ import annotations

import random

from tidepanel.operators.accounts import exposures
from tidepanel.operators.ordering import places, pooled_rank_corr, pooled_ranks


def _rows(n=400):
    r = random.Random(3)
    hot = [(i, 5.0 if i % 3 == 0 else None if i % 17 == 0 else float("nan") if i % 19 == 0 else round(r.uniform(-9, 9), 1)) for i in range(n)]
    r.shuffle(hot)
    return hot


def test_places_with_a_hot_value(spark):
    rows = _rows()
    said = places(spark.createDataFrame(rows, "id long, v double"), "v", "id", parts=8).collect()
    missing = lambda v: v is None or v != v
    order = sorted(rows, key=lambda x: (missing(x[1]), 0 if missing(x[1]) else -x[1], x[0]))
    assert {r["id"]: r["place"] for r in said} == {i: k + 1 for k, (i, _) in enumerate(order)}


def test_places_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert places(none, "v", "id").collect() == []
    same = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, v double")
    assert {r["id"]: r["place"] for r in places(same, "v", "id").collect()} == {i: i + 1 for i in range(50)}


def test_pooled_ranks(spark):
    rows = [(i % 2, i, float(i % 7) if i % 11 else None) for i in range(200)]
    said = pooled_ranks(spark.createDataFrame(rows, "g int, id long, v double"), "v", "r", "g", parts=4).collect()
    for g in (0, 1):
        known = [v for h, _, v in rows if h == g and v is not None]
        for r in said:
            if r["g"] == g:
                v = r["v"]
                assert r["r"] == (None if v is None else sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2)


def test_pooled_corr_without_variation(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)] + [("b", float(i), float(i * i)) for i in range(5)], "g string, x double, y double")
    out = {r["g"]: r["pooled"] for r in pooled_rank_corr(df, "x", "y", "g").collect()}
    assert out["a"] is None and abs(out["b"] - 1) < 1e-12


def test_exposures_meet_once(spark):
    rows = [(1, "k", "2024-01-01", "2024-06-01", ["x"]), (2, "k", "2024-03-01", "2024-08-01", ["x"]), (3, "k", "2024-06-01", "2024-06-02", ["*"]), (4, "k", "2024-03-05", "2024-03-05", ["x"]), (5, "j", "2024-03-01", "2024-08-01", ["x"])]
    df = spark.createDataFrame(rows, "id long, k string, s string, t string, scope array<string>").selectExpr("id", "k", "to_date(s) s", "to_date(t) t", "scope")
    assert sorted((r["a"], r["b"]) for r in exposures(df, "k", 7).collect()) == [(1, 2), (2, 3)]
