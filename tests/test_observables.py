"""Trade labels, session scores, reviews and order checks by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from tidepanel.operators import observables as ob
from tidepanel.operators import quality as dq
from tidepanel.operators import selection as sel

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


def test_trade_labels(spark):
    sessions = spark.createDataFrame([(day(n),) for n in (0, 2, 4, 6)], "session date")
    prices = spark.createDataFrame([(1, day(0), 10.0), (1, day(2), 0.0), (1, day(4), 12.0), (1, day(6), 15.0), (2, day(2), 5.0)], "security_id int, session date, price double")
    signals = spark.createDataFrame([(1, day(-1)), (1, day(0)), (1, day(3)), (1, day(5)), (2, day(1)), (3, day(9))], "security_id int, cutoff date")
    found = {(r["security_id"], r["cutoff"]): (r["entry"], r["exit"], r["forward_return"], r["label_status"]) for r in ob.trade_labels(signals, prices, sessions, 1).collect()}
    nothing = (None, None, None, "INSUFFICIENT_FUTURE_DATA")
    assert found == {
        (1, day(-1)): (day(0), day(2), -1.0, "AVAILABLE"), (1, day(0)): (day(2), day(4), None, "INVALID_PRICE"), (1, day(3)): (day(4), day(6), 0.25, "AVAILABLE"), (1, day(5)): nothing,
        (2, day(1)): (day(2), day(4), None, "INVALID_PRICE"), (3, day(9)): nothing}
    with pytest.raises(ValueError, match="INVALID_HORIZON"):
        ob.trade_labels(signals, prices, sessions, 0)


def test_session_scores(spark):
    rows = [(f, day(0), s, float(s)) for f in "ab" for s in range(20)] + [(f, day(1), s, None if f == "b" and s < 2 else 1.0) for f in "ab" for s in range(20)]
    out = sel.session_scores(spark.createDataFrame(rows, "factor_id string, session date, security_id int, score double"), 2, min_complete=19).collect()
    said = {r["session"]: (r["n_complete"], r["blockers"]) for r in out}
    assert said == {day(0): (20, []), day(1): (18, ["ACTIVE_FACTOR_COVERAGE_BELOW_95_PERCENT", "COMPLETE_COMPOSITE_BELOW_500"])}
    assert sum(r["composite_score"] is None for r in out) == 2


def test_review_needs_coverage(spark):
    catalogue = spark.createDataFrame([("a", "m", "x,y", "FULL_INTENT", 3, True), ("b", "m", None, "OTHER", 1, True), ("c", "m", "x,y", "FULL_INTENT", 2, True), ("d", "n", "x", "FULL_INTENT", 1, False)], "factor_id string, mechanism_tag string, allowed_providers string, semantic_status string, warmup_sessions int, eligible boolean")
    coverage = spark.createDataFrame([("a", 0.9), ("b", 1.0), ("c", 0.9)], "factor_id string, coverage double")
    out = {r["factor_id"]: (r["mechanism_rank"], r["structural_recommendation"]) for r in sel.review_candidates(catalogue, coverage, ("x", "y")).collect()}
    assert out == {"c": (1, True), "a": (2, False), "b": (3, False)}
    with pytest.raises(Exception, match="CANDIDATE_COVERAGE_MISSING: b"):
        sel.review_candidates(catalogue, coverage.where("factor_id != 'b'"), ("x", "y")).collect()
    with pytest.raises(Exception, match="NOT_ONE_TO_ONE"):
        sel.review_candidates(catalogue, coverage.unionByName(coverage), ("x", "y")).collect()


def test_monotonic_sessions(spark):
    rows = spark.createDataFrame([(1, 1, day(0)), (1, 2, day(1)), (1, 3, day(1)), (1, 4, day(0)), (2, 1, None), (2, 2, day(0))], "k int, row int, session date")
    assert dq.monotonic_check(rows, "X", ["k"], "row").first()["failed_rows"] == 3
