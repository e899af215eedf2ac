"""Hand-computed cases of the operators."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions import timeseries as ts
from tidepanel.operators import asof, diagnostics, quality, selection
from tidepanel.operators.factor import Factor, col, evaluate, rank, ts_delta, ts_mean, ts_std_dev


def panel(spark, **columns):
    """Rows (session, security_id, x) from a list for each security."""
    rows = [(i, k, None if v is None else float(v)) for k, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session int, security_id string, x double")


def got(df, value, security="A"):
    rows = df.select("session", "security_id", value.alias("v")).where(F.col("security_id") == security).orderBy("session").collect()
    return [r["v"] for r in rows]


x = lambda: F.col("x")


def test_trailing(spark):
    df = panel(spark, A=[1, 2, 2, 4])
    assert got(df, ts.ts_delta(x(), 1)) == [None, 1, 0, 2]
    assert got(df, ts.ts_delay(x(), 1)) == [None, 1, 2, 2]
    assert got(df, ts.ts_mean(x(), 2))[-1] == 3
    assert got(df, ts.ts_std_dev(x(), 2))[-1] == 1
    assert got(df, ts.ts_rank(x(), 3))[2] == pytest.approx(2.5 / 3)
    assert got(panel(spark, A=[1, 2]), ts.linear_decay(x(), 2))[-1] == pytest.approx(5 / 3)
    args = panel(spark, A=[5, 1, 3, 9])
    assert got(args, ts.ts_arg_min(x(), 4))[-1] == 2
    assert got(args, ts.ts_arg_max(x(), 4))[-1] == 0
    assert got(panel(spark, A=[2, 2, 4, 4], B=[1, 1, 1, 1]), ts.ts_scale(x(), 3), "B") == [None] * 4


def test_missing_values_break_windows(spark):
    df = panel(spark, A=[1, None, 3, 4, 5])
    assert got(df, ts.ts_mean(x(), 2)) == [None, None, None, 3.5, 4.5]
    assert got(df, ts.ts_arg_min(x(), 2))[1:3] == [None, None]
    with pytest.raises(ValueError):
        ts.trailing(0)


def test_correlation_of_flat_window(spark):
    df = panel(spark, A=[1, 1, 1, 2]).withColumn("y", F.col("session").cast("double"))
    assert got(df, ts.ts_corr(x(), F.col("y"), 3))[2] is None


def test_ranks(spark):
    df = panel(spark, A=[1], B=[3], C=[None], D=[2], E=[2])
    shares = {r["security_id"]: r["v"] for r in df.select("security_id", cs.rank(x()).alias("v")).collect()}
    assert shares == {"A": 0.25, "B": 1.0, "C": None, "D": 0.625, "E": 0.625}


def test_factor_delay_and_prefix(spark):
    df = panel(spark, A=[1, 2, 4, 8], B=[1, 3, 4, 5]).withColumnRenamed("x", "close")
    factor = Factor("f", rank(ts_delta(col("close"), 1)), delay=1)
    rows = {(r["session"], r["security_id"]): r["f"] for r in evaluate(df, [factor]).collect()}
    assert rows[2, "A"] == 0.5 and rows[2, "B"] == 1.0
    assert rows[1, "A"] is None and rows[1, "B"] is None
    assert factor.warmup == 2
    nested = Factor("g", ts_mean(ts_std_dev(col("close"), 2), 2) + ts_std_dev(col("close"), 2))
    assert nested.expression.depth == 2
    assert quality.prefix_invariant(df, lambda p: evaluate(p, [factor, nested]), F.lit(2)).count() == 0


def test_latest_revision_keeps_missing(spark):
    rows = spark.createDataFrame([("a", 100.0, 1), ("a", None, 2), ("a", 120.0, 4)], "k string, v double, available_at int")
    assert asof.latest(rows, ["k"], ["available_at"], F.col("available_at") <= 1).first()["v"] == 100
    assert asof.latest(rows, ["k"], ["available_at"], F.col("available_at") <= 3).first()["v"] is None


def test_pit_panel(spark):
    v = spark.createDataFrame([("a", 1, 3, "x", 100.0), ("a", 2, 5, "y", 125.0), ("a", 1, 7, "z", 90.0)], "security_id string, period_end int, available_at int, accession string, value double")
    cal = spark.createDataFrame([(i,) for i in range(2, 9)], "session int")
    rows = {r["session"]: r["value"] for r in asof.pit_panel(v, cal, ["security_id"]).collect()}
    # the older period's restatement never replaces the newer period
    assert rows == {3: 100, 4: 100, 5: 125, 6: 125, 7: 125, 8: 125}


@pytest.mark.parametrize(("change", "status", "reason"), [
    ({}, "PASS_GATES", "PASS_ALL_GATES"), ({"icir": None}, "PASS_GATES", "PASS_ALL_GATES"), ({"icir": -1.0}, "PASS_GATES", "PASS_ALL_GATES"),
    ({"median_coverage": None}, "REJECT_DATA", "MISSING_DATA_DIAGNOSTIC"), ({"median_coverage": 0.9, "mean_ic": -1.0}, "REJECT_DATA", "MEDIAN_COVERAGE_BELOW_MINIMUM"), ({"n_sessions": 99}, "REJECT_DATA", "VALID_SIGNAL_SESSIONS_BELOW_MINIMUM"),
    ({"spread": float("nan")}, "REJECT_SIGNAL", "MISSING_SIGNAL_DIAGNOSTIC"), ({"mean_ic": -0.01, "spread": -0.02}, "REJECT_SIGNAL", "NONPOSITIVE_MEAN_RANK_IC"), ({"spread": 0.0}, "REJECT_SIGNAL", "NONPOSITIVE_Q5_MINUS_Q1"),
    ({"positive_year_ratio": None}, "WATCHLIST_UNSTABLE", "MISSING_POSITIVE_YEAR_RATIO"), ({"positive_year_ratio": 0.5, "turnover": 0.9}, "WATCHLIST_UNSTABLE", "POSITIVE_YEAR_RATIO_BELOW_MINIMUM"),
    ({"turnover": None}, "WATCHLIST_HIGH_TURNOVER", "MISSING_WEEKLY_TOP10_TURNOVER"), ({"turnover": 0.9}, "WATCHLIST_HIGH_TURNOVER", "WEEKLY_TOP10_TURNOVER_ABOVE_MAXIMUM")])
def test_gates(spark, change, status, reason):
    row = {"factor_id": "f", "n_sessions": 100, "median_coverage": 0.99, "mean_ic": 0.02, "icir": 0.2, "spread": 0.01, "positive_year_ratio": 0.8, "turnover": 0.5} | change
    df = spark.createDataFrame([tuple(row.values())], "factor_id string, n_sessions int, median_coverage double, mean_ic double, icir double, spread double, positive_year_ratio double, turnover double")
    said = selection.gated(df).first()
    assert (said["status"], said["reason"]) == (status, reason)


def test_gates_never_turn_a_factor(spark):
    with pytest.raises(Exception, match="FILTER_DIRECTION_MUST_BE_ONE"):
        selection.gated(spark.createDataFrame([(100, 0.99, 0.02, 0.01, 0.8, 0.5, -1)], "n_sessions int, median_coverage double, mean_ic double, spread double, positive_year_ratio double, turnover double, direction int")).collect()


def test_greedy(spark):
    c = spark.createDataFrame([(f"F{i}", i) for i in range(1, 6)] + [("A0", 6)], "factor_id string, place int")
    conflicts = spark.createDataFrame([("F1", "F2"), ("F3", "F2"), ("A0", "F3"), ("F1", "A0")], "factor_a string, factor_b string")
    said = {r["factor_id"]: (r["status"], r["reason"]) for r in selection.greedy(c, conflicts, most=3).collect()}
    taken, cap = ("SELECTED", "SELECTED_NONREDUNDANT"), ("REJECT_POOL_CAP", "ACTIVE_POOL_MAX_REACHED")
    clash = ("REJECT_REDUNDANT", "REJECT_REDUNDANT_WITH_F1")
    assert said == {"F1": taken, "F2": clash, "F3": taken, "F4": taken, "F5": cap, "A0": clash}
    with pytest.raises(Exception, match="TOO_MANY_CANDIDATES"):
        selection.greedy(c, conflicts, most_candidates=5).collect()


def test_candidate_order(spark):
    cols = "positive_year_ratio double, icir double, mean_ic double, spread double, turnover double, median_coverage double, semantic_status string, warmup_sessions int, factor_id string, factor_version int"
    base = (0.8, 0.2, 0.02, 0.01, 0.5, 0.99, "FULL_INTENT", 5, "m", 1)
    better = [(0.9,), (0.3,), (0.03,), (0.02,), (0.4,), (1.0,), ("FULL_INTENT",), (4,), ("a",), (0,)]
    worse_semantic = (*base[:6], "PARTIAL_INTENT", *base[7:])
    for k, (value,) in enumerate(better):
        first, second = (base, worse_semantic) if k == 6 else ((*base[:k], value, *base[k + 1 :]), base)
        # whatever comes after the key can't outweigh it
        tail = tuple(None for _ in base[k + 1 : 8]) + base[max(k + 1, 8) :]
        rows = [(i, *r) for i, r in ((1, second), (0, (*first[: k + 1], *tail) if k < 6 else first))]
        assert spark.createDataFrame(rows, f"k int, {cols}").orderBy(*selection.candidate_order()).first()["k"] == 0, k


def test_conflicts_and_messages(spark):
    good = spark.createDataFrame([("a", "x", "m"), ("b", "x", "m"), ("c", "y", "n"), ("d", "z", "o")], "factor_id string, family_id string, mechanism_tag string")
    measured = spark.createDataFrame([("a", "b", 0.1, 0.1), ("a", "c", 0.81, 0.7), ("b", "c", 0.8, 0.71), ("c", "d", None, None)], "factor_a string, factor_b string, median_abs_ic double, top_jaccard double")
    said = {(r["factor_a"], r["factor_b"]): r["conflict_reason"] for r in selection.conflicts(good, measured).collect()}
    assert said == {("a", "b"): "SAME_FAMILY", ("a", "c"): "SCORE_CORRELATION", ("b", "c"): "TOP10_OVERLAP", ("a", "d"): "", ("b", "d"): "", ("c", "d"): ""}
    pool = good.withColumn("status", F.lit("SELECTED"))
    assert selection.pool_messages(pool).first()["messages"] == ["COMPOSITE_BLOCKED_INSUFFICIENT_ALPHA", "SAME_MECHANISM_INCLUDED"]
    assert selection.pool_messages(pool.where("factor_id != 'b'"), 3).first()["messages"] == []


def test_redundancy_on_rows_that_both_have(spark):
    rows = [("f", 1, i, float(i)) for i in range(20)] + [("g", 1, i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "factor_id string, session int, security_id int, score double")
    said = diagnostics.redundancy(df).first()
    assert said["median_abs_ic"] == pytest.approx(1) and said["top_jaccard"] == 1


def test_diagnose_rejects_what_does_not_fit(spark):
    schema = "factor_id string, session date, security_id int, score double, forward_return double"
    day = datetime.date(2024, 1, 1)
    rows = [("f", day + datetime.timedelta(7 * w), i, float(i), float(i)) for w in range(30) for i in range(10)]
    one = diagnostics.diagnose(spark.createDataFrame(rows, schema), benchmark=99).first()
    assert (one["n_sessions"], one["mean_ic"], one["positive_year_ratio"], one["turnover"], one["median_coverage"]) == (30, pytest.approx(1), 1, 0, 1) and one["spread"] > 0
    with pytest.raises(Exception, match="BENCHMARK_IN_FACTOR_CROSS_SECTION"):
        diagnostics.diagnose(spark.createDataFrame(rows, schema), benchmark=3).collect()
    scores = spark.createDataFrame(rows, schema).drop("forward_return")
    labels = spark.createDataFrame(rows, schema).drop("score", "factor_id")
    assert diagnostics.aligned(scores, labels).count() == len(rows)
    for a, b in ((scores.where("security_id != 4"), labels), (scores, labels.where("session != date'2024-01-08'"))):
        with pytest.raises(Exception, match="FACTOR_LABEL_ALIGNMENT_MISMATCH"):
            diagnostics.aligned(a, b).collect()


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    checks = quality.count_checks(df, {"KEY": F.col("k") > 0, "TEXT": F.col("v") != ""})
    assert {r["check"]: r["failed_rows"] for r in checks.collect()} == {"KEY": 1, "TEXT": 0}
    with pytest.raises(quality.CheckFailed, match="KEY"):
        quality.assert_clean(checks)


def test_diagnose_ranks_each_cross_section_in_one_shuffle(spark):
    """Rows meet once, by factor and session, whatever the ids are; a factor without values has none of its measures."""
    days = [datetime.date(2024, 1, d) for d in (1, 8, 15)]
    rows = [(f, day, s, None if f == "none" else x + i, x) for f in ("some", "none") for i, day in enumerate(days) for x, s in ((1.0, "b"), (1.0, "a"), (3.0, "c"), (4.0, "d"))]
    out = diagnostics.diagnose(spark.createDataFrame(rows, "factor_id string, session date, security_id string, score double, forward_return double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "security_id" not in plan.split("FlatMapGroupsInArrow")[0]
    found = {r["factor_id"]: r for r in out.collect()}
    assert (found["some"]["n_sessions"], round(found["some"]["mean_ic"], 9), found["some"]["turnover"], found["some"]["median_coverage"]) == (3, 1.0, 0.0, 1.0)
    assert (found["none"]["n_sessions"], found["none"]["mean_ic"], found["none"]["turnover"], found["none"]["median_coverage"]) == (0, None, None, 0.0)
