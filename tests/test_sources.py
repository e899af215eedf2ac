"""Aligned inputs, session times, bases, mapping of parts and the rank cache."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.factor import Factor, col, ts_delta
from tidepanel.operators.fundamentals import inputs, periods
from tidepanel.operators.fundamentals.inputs import Binding
from tidepanel.sources import sessions, sinks

PANEL = "session date, security_id string, field string, basis string, mode string, grade string, value double"
D1, D2 = dt.date(2024, 1, 31), dt.date(2024, 2, 29)
DIRECT, MODE = "SOURCE_LINKED_DIRECT", "HISTORICAL_DIAGNOSTIC"


def _panel(spark, *more):
    rows = [(D1, "a", "revenue", "TTM", MODE, DIRECT, 1.0), (D2, "a", "revenue", "TTM", MODE, DIRECT, 3.0), (D1, "b", "assets", "INSTANT", MODE, inputs.PROXY, 5.0), (D1, "a", "revenue", "TTM", "FORWARD_OBSERVED", DIRECT, 9.0), (D1, "c", "other", "RAW", MODE, DIRECT, 7.0)]
    return spark.createDataFrame([*rows, *more], PANEL), spark.createDataFrame([(D1,), (D2,)], "session date")


def test_aligned(spark):
    panel, calendar = _panel(spark)
    both = [Binding("revenue", "TTM"), Binding("assets", "INSTANT", proxy=True)]
    got = {(r["session"], r["security_id"]): (r["revenue__TTM"], r["assets__INSTANT"]) for r in inputs.aligned(panel, both, calendar).collect()}
    assert got == {(D1, "a"): (1.0, None), (D2, "a"): (3.0, None), (D1, "b"): (None, 5.0), (D2, "b"): (None, None)}
    real = inputs.aligned(panel, [both[0], Binding("assets", "INSTANT")], calendar)
    assert {r["security_id"] for r in real.collect()} == {"a"}
    late = inputs.aligned(panel, both, calendar, start=D2)
    assert [(r["session"], r["security_id"]) for r in late.collect()] == [(D2, "a")]
    assert inputs.aligned(panel.limit(0), both, calendar).count() == 0


def test_evaluated(spark):
    panel, calendar = _panel(spark)
    both = [Binding("revenue", "TTM"), Binding("assets", "INSTANT", proxy=True)]
    grid = inputs.aligned(panel, both, calendar)
    out = inputs.evaluated(grid, both, [Factor("growth", ts_delta(col("revenue__TTM"), 1))])
    assert [r["growth"] for r in out.where("security_id = 'a'").orderBy("session").collect()] == [None, 2.0]
    with pytest.raises(ValueError, match="INPUT_SET_MISMATCH"):
        inputs.evaluated(grid, both, [Factor("x", col("price"))])
    with pytest.raises(ValueError, match="STRICT_PROXY_INPUT"):
        inputs.evaluated(grid, both, [Factor("x", col("assets__INSTANT"))])
    assert inputs.evaluated(grid, both, [Factor("x", col("assets__INSTANT"))], strict=False).count() == 4


def test_bindings_refused(spark):
    panel, calendar = _panel(spark, (D1, "a", "revenue", "TTM", MODE, DIRECT, 2.0))
    with pytest.raises(ValueError, match="INPUT_BINDINGS_EMPTY"):
        inputs.aligned(panel, [], calendar)
    with pytest.raises(ValueError, match="INPUT_ALIAS_DUPLICATE"):
        inputs.aligned(panel, [Binding("revenue", "TTM"), Binding("revenue", "TTM", True)], calendar)
    with pytest.raises(Exception, match="INPUT_DUPLICATE_CELL"):
        inputs.aligned(panel, [Binding("revenue", "TTM")], calendar).collect()


def test_session_bounds(spark):
    calendar = spark.createDataFrame([(dt.date(2024, 1, 2), False), (dt.date(2024, 7, 3), True), (dt.date(2024, 7, 5), None)], "session date, early boolean")
    asked = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 7, 3),), (dt.date(2024, 7, 4),), (dt.date(2024, 7, 5),)], "session date")
    got = {r["session"].isoformat(): (r["open_at"], r["close_at"], r["status"]) for r in sessions.bounds_of(asked, calendar).collect()}
    at = lambda d, h, m=0: dt.datetime.combine(dt.date.fromisoformat(d), dt.time(h, m))
    assert got == {
        "2024-01-02": (at("2024-01-02", 14, 30), at("2024-01-02", 21), "SESSION"), "2024-07-03": (at("2024-07-03", 13, 30), at("2024-07-03", 17), "SESSION"),
        "2024-07-04": (None, None, "NOT_A_SESSION"), "2024-07-05": (at("2024-07-05", 13, 30), at("2024-07-05", 20), "SESSION")}


def test_rank_cache(spark, tmp_path):
    path = str(tmp_path / "ranks")
    rows = spark.createDataFrame([("f", 1, D1, i, i / 4) for i in range(4)] + [("g", 1, D1, i, None) for i in range(3)], "factor_id string, factor_version int, session date, security_id long, score double")
    first = sinks.write_rank_cache(rows, path)
    assert {r["factor_id"]: r["n_rows"] for r in first.collect()} == {"f": 4, "g": 3}
    sinks.write_rank_cache(rows.orderBy(F.desc("security_id")), path)
    assert spark.read.parquet(path).count() == 7
    changed = rows.withColumn("score", F.when(F.col("factor_id") == "f", F.col("score") + 1).otherwise(F.col("score")))
    second = sinks.write_rank_cache(changed, path)
    assert spark.read.parquet(path).count() == 11
    for contents, total in ((first, 1.5), (second, 5.5)):
        got = sinks.read_rank_cache(spark, path, contents)
        assert got.count() == 7 and got.agg(F.sum("score")).first()[0] == total


def test_bases_of_instants(spark):
    one = lambda field, kind, fp, start, end, v: ("x", field, "usd", 2024, fp, start, end, "2025-01-01", f"{field}{fp}", f"{field}{fp}", v, kind)
    rows = [one("assets", "INSTANT", "FY", None, "2024-12-31", 5.0), one("revenue", "DURATION", "FY", "2024-01-01", "2024-12-31", 9.0), one("short", "DURATION", "FY", "2024-06-01", "2024-12-31", 2.0)]
    df = spark.createDataFrame(rows, "security_id string, field string, unit string, fiscal_year int, fiscal_period string, a string, b string, c string, accession string, source_id string, value double, fact_type string")
    df = df.select("*", F.to_date("a").alias("period_start"), F.to_date("b").alias("period_end"), F.to_date("c").alias("available_at"))
    got = sorted((r["field"], r["basis"], r["grade"]) for r in periods.by_basis(df).collect())
    assert got == [("assets", "INSTANT", DIRECT), ("assets", "RAW", DIRECT), ("revenue", "ANNUAL", DIRECT), ("revenue", "RAW", DIRECT), ("revenue", "TTM", "HYPOTHESIS_PROXY"), ("short", "RAW", DIRECT)]
