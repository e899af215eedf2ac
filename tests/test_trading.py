"""First touches against a plain loop, positions through dated events walked by hand, quotes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import accounts as ac
from tidepanel.operators import events as ev
from tidepanel.operators import fills

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


@pytest.mark.parametrize("width", [2, 4, 64])
def test_first_touch_against_loop(spark, width, monkeypatch):
    monkeypatch.setattr(fills, "WIDTH", width)
    rng = random.Random(width)
    bars = [(s, day(n), day(n + 1), low := rng.uniform(5, 20), low + rng.uniform(0, 5), float(rng.randrange(200))) for s in range(4) for n in range(0, 70, 1 + s)]
    orders = [(i, rng.randrange(6), rng.choice(("BUY", "SELL", "SELL", "HOLD")), rng.randrange(25), rng.choice((0.0, rng.uniform(4, 7), rng.uniform(22, 26), 12.0)), day(rng.randrange(-3, 75))) for i in range(200)]
    found = fills.first_touch(spark.createDataFrame(orders, "order_id int, security_id int, side string, quantity int, limit double, submitted date"), spark.createDataFrame(bars, "security_id int, session date, end date, low double, high double, volume double"))
    want = []
    for i, s, side, quantity, limit, submitted in orders:
        after = sorted(b for b in bars if b[0] == s and b[1] >= submitted)
        hit = next((b for b in after if (side == "BUY" and b[3] < limit) or (side == "SELL" and b[4] > limit)), None)
        if side == "HOLD" or limit <= 0:
            want.append((i, None, 0, "INVALID_FILL_INPUT"))
        elif not after:
            want.append((i, None, 0, "PRE_SUBMISSION_BAR_EXCLUDED"))
        elif hit is None:
            want.append((i, None, 0, "NO_TOUCH"))
        else:
            n = min(quantity, int(hit[5] * 0.1 // 1))
            want.append((i, hit[1], n, "PARTIAL" if n < quantity else "APPROXIMATED_FILL"))
    rows = found.collect()
    assert sorted((r["order_id"], r["session"], r["filled"], r["status"]) for r in rows) == want
    assert len({w[3] for w in want}) == 5
    assert all((r["price"] is None) == (r["filled"] == 0) and (r["available_at"] is None) == (r["filled"] == 0) for r in rows)


def test_no_bars(spark):
    orders = spark.createDataFrame([(1, 1, "BUY", 5, 10.0, DAY)], "order_id int, security_id int, side string, quantity int, limit double, submitted date")
    bars = spark.createDataFrame([], "security_id int, session date, end date, low double, high double, volume double")
    assert fills.first_touch(orders, bars).first()["status"] == "PRE_SUBMISSION_BAR_EXCLUDED"
    assert fills.first_touch(orders.limit(0), bars).count() == 0
    with pytest.raises(ValueError, match="INVALID_FILL_INPUT"):
        fills.filled(F.lit(1), F.lit(1), 0.0)


def test_touch_is_strict(spark):
    df = spark.createDataFrame([("BUY", 10.0, 10.0, 12.0), ("BUY", 10.01, 10.0, 12.0), ("SELL", 12.0, 10.0, 12.0), ("SELL", 11.99, 10.0, 12.0)], "side string, limit double, low double, high double")
    fill = fills.bar_fill(F.col("side"), F.lit(3), F.col("limit"), F.lit(DAY), F.lit(DAY), F.lit(day(1)), F.col("low"), F.col("high"), F.lit(100.0), 0.02)
    assert [tuple(r["f"])[::3] for r in df.select(fill.alias("f")).collect()] == [(0, "NO_TOUCH"), (2, "PARTIAL"), (0, "NO_TOUCH"), (2, "PARTIAL")]


EVENTS = "security_id int, at date, kind string, event_id string, amount double, entitlement string"


def test_positions_through_events(spark):
    rows = [
        (1, day(0), "trade", "t1", 10.0, None), (1, day(5), "split", "s1", 1.5, None), (1, day(5), "trade", "t2", 4.0, None), (1, day(6), "dividend_ex", "x1", 0.5, None), (1, day(6), "trade", "t3", 100.0, None),
        (1, day(8), "split", "s2", 0.25, None), (1, day(9), "dividend_pay", "p1", None, "x1"), (1, day(10), "dividend_pay", "p2", None, "x1"), (1, day(11), "delisting", "d1", 2.0, None), (1, day(12), "trade", "t4", 1.0, None),
        (2, day(0), "dividend_pay", "p3", None, "x2"), (2, day(1), "dividend_ex", "x2", 1.0, None), (2, day(2), "trade", "t5", -3.0, None), (2, day(3), "split", "s3", 0.0, None), (2, day(4), "dividend_ex", "x3", -1.0, None)]
    held = ev.held(spark.createDataFrame(rows, EVENTS)).cache()
    said = {r["event_id"]: (r["before"], r["shares"], r["status"]) for r in held.collect()}
    assert said["s1"] == (10.0, 15.0, "OK") and said["t2"] == (15.0, 19.0, "OK") and said["x1"] == (19.0, 19.0, "OK") and said["t3"][:2] == (19.0, 119.0)
    assert said["s2"] == (119.0, pytest.approx(29.75), "FRACTIONAL_SPLIT_CASH_IN_LIEU_REQUIRED") and said["d1"][1] == 0.0 and said["t4"] == (0.0, 1.0, "TRADE_AFTER_DELISTING")
    assert said["t5"][2] == "NEGATIVE_POSITION" and said["s3"] == (-3.0, -3.0, "INVALID_SPLIT")
    claims = ev.dividends(held)
    told = {r["event_id"]: (r["entitlement"], r["pay_at"], r["status"]) for r in claims.collect()}
    assert told == {"x1": (9.5, day(9), "PAID"), "p1": (9.5, day(9), "PAYMENT"), "p2": (9.5, day(10), "UNKNOWN_OR_PAID_ENTITLEMENT"), "p3": (None, day(0), "UNKNOWN_OR_PAID_ENTITLEMENT"), "x2": (0.0, None, "RECEIVABLE"), "x3": (None, None, "INVALID_DIVIDEND")}
    assert {r["at"]: r["receivable"] for r in ev.receivables(claims).collect()} == {day(1): 0.0, day(6): 9.5, day(9): 0.0}


def test_later_splits_only(spark):
    held = spark.createDataFrame([(1, 10, day(0)), (1, 10, day(5)), (2, 3, day(0))], "security_id int, shares int, at date")
    splits = spark.createDataFrame([(1, 2.0, day(3)), (1, 0.5, day(5)), (2, 0.5, day(9))], "security_id int, ratio double, effective_at date")
    assert sorted((r["security_id"], r["at"], r["shares"], r["whole"]) for r in ac.split_shares(held, splits).collect()) == [(1, day(0), 10.0, True), (1, day(5), 10.0, True), (2, day(0), 1.5, False)]


def test_quotes(spark):
    now, t = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 11, 59)
    good = (1.0, 1.5, t, t, "SIP", False, "USD", "REGULAR", False)
    rows = [("good", 1, *good), ("twice", 1, *good), ("twice", 2, *good), ("low", 1, 0.0, *good[1:]), ("nan", 1, float("nan"), *good[1:]), ("old", 1, 1.0, 1.5, t - dt.timedelta(hours=1), *good[3:]), ("order", 1, *good[:3], t - dt.timedelta(seconds=1), *good[4:]),
            ("untimed", 1, 1.0, 1.5, None, *good[3:]), ("rest", 1, *good[:4], None, None, "EUR", "REGULAR", None)]
    quotes = spark.createDataFrame(rows, "security_id string, seq int, bid double, ask double, quote_time timestamp, received_at timestamp, feed string, delayed boolean, currency string, session string, halted boolean")
    told = lambda skew: {r["security_id"]: r["reasons"] for r in ac.quote_reasons(quotes, F.lit(now), "SIP", 600, skew).collect()}
    said = told(10_000)
    assert said == {
        "good": [], "twice": ["DUPLICATE_QUOTE"], "low": ["CROSSED_OR_INVALID_QUOTE"], "nan": ["INVALID_QUOTE"], "old": ["STALE_QUOTE"], "order": ["QUOTE_TIME_ORDER"], "untimed": ["UNKNOWN_QUOTE_TIME"],
        "rest": ["FEED_MISMATCH", "DELAYED_OR_UNKNOWN_FEED", "INVALID_CURRENCY_OR_SESSION", "HALTED_OR_UNKNOWN"]}
    assert told(60) == {k: [*v, "QUOTE_SKEW"] for k, v in said.items()}
