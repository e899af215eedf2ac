"""Weekly factors stay columns of one panel that is dealt by security once, and then by session."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.operators import diagnostics as dg
from tidepanel.operators import portfolio as pf
from tidepanel.operators import selection as sel
from tidepanel.plans import factor_queries as fq
from tidepanel.plans import holdout_queries as hq
from tidepanel.sources import panels

SMALL = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def wide_rows(spark, seed=5):
    """Three factors over 60 weeks and 30 securities, with ties, values that are missing or not finite, and labels likewise."""
    pick = random.Random(seed)
    value = lambda: pick.choice([None, float("nan"), float("inf"), *(pick.randint(-9, 9) / 4 for _ in range(17))])
    rows = [(DAY + dt.timedelta(7 * d), s, value(), value(), value(), float(s % 7)) for d in range(60) for s in range(30)]
    return spark.createDataFrame(rows, "session date, security_id long, forward_return double, a double, b double, c double")


def near(x, y):
    return (x is None and y is None) or (x is not None and y is not None and x == pytest.approx(y, abs=1e-12))


def same(left, right, keys):
    of = lambda df: {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
    x, y = of(left), of(right)
    assert x.keys() == y.keys() and len(x) == left.count()
    for k in x:
        assert all(near(x[k][c], y[k][c]) if isinstance(x[k][c], float) else x[k][c] == y[k][c] for c in x[k]), (x[k], y[k])


def test_columns_give_what_long_rows_give(spark):
    wide = wide_rows(spark)
    long = wide.unpivot(["session", "security_id", "forward_return"], ["a", "b", "c"], "factor_id", "score")
    found = dg.cross_sections(wide, ["a", "b", "c"], 3, pairs=True).cache()
    same(dg.diagnosed(found), dg.diagnose(long), ["factor_id"])
    same(dg.redundant(found), dg.redundancy(long), ["factor_a", "factor_b"])


def test_shares_and_composites_of_columns(spark):
    wide = wide_rows(spark)
    long = wide.unpivot(["session", "security_id", "forward_return"], ["a", "b", "c"], "factor_id", "score").withColumn("score", sc.finite(F.col("score")))
    shares = dg.rank_shares(wide, ["a", "b", "c"], 3).cache()
    ics = shares.select("session", F.inline(F.array(*(F.struct(F.lit(f).alias("factor_id"), F.col(f"ic_{f}").alias("ic"), F.col(f"n_{f}").alias("n")) for f in "abc")))).distinct()
    same(ics, dg.rank_ic(long, ["factor_id", "session"]), ["factor_id", "session"])
    pools, directions = {"ALL": ("a", "b", "c"), "TWO": ("a", "c")}, spark.createDataFrame([("a", 1), ("b", -1), ("c", -1)], "factor_id string, direction int")
    plain = sel.composites(long.withColumn("share", sel.cs.rank(F.col("score"), "factor_id", "session")), pools, directions)
    same(sel.wide_composites(shares.select("session", "security_id", "a", "b", "c"), pools, directions).select(plain.columns), plain, ["composite_id", "session", "security_id"])


def test_bars_fill_the_grid(spark):
    day = lambda n: DAY + dt.timedelta(7 * n)
    rows = spark.createDataFrame([(day(2), 1, 1.0), (day(4), 1, 2.0), (day(0), 2, 3.0), (None, 3, 4.0), (None, 4, 5.0), (day(3), 4, 6.0), (day(1), 5, None)], "session date, security_id long, close double")
    found = panels.filled_grid(rows.repartition(2, "security_id"), rows.select("session"), "close")
    key = lambda r: (r["session"], r["security_id"], r["close"] is None, r["close"])
    assert sorted(map(key, found.collect())) == sorted(map(key, panels.densify(rows).collect()))


def test_rounding_is_that_of_decimals(spark):
    pick = random.Random(3)
    xs = [0.0, -0.0, 0.5, 1.5, -2.5, 2.675, 1.0000000005, -1.0000000005, 0.1234567895, 1e-10, 5e-10, -5e-10, 1e300, 2.0**53 + 2, None, float("nan"), float("-inf")]
    xs += [pick.uniform(-1e5, 1e5) for _ in range(5000)] + [pick.randint(-(10**6), 10**6) / 2**k for k in range(1, 40) for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    bad = df.where(~sc.rounded(F.col("x"), 9).eqNullSafe(F.round("x", 9)) | ~sc.rounded(F.col("x"), 2).eqNullSafe(F.round("x", 2)))
    assert bad.count() == 0


@pytest.mark.parametrize("rows", [lambda s: fq.weekly_sections(s, SMALL, pairs=True), lambda s: dg.rank_shares(fq.weekly_scores(s, SMALL, hq.POOLS["ALL"]), list(hq.POOLS["ALL"]), 4)])
def test_one_row_for_a_security_and_two_shuffles_of_rows(spark, rows):
    plan = rows(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(security_id") == 1 and plan.count("Exchange hashpartitioning(session") <= 2  # the calendar has one, too


def test_prices_are_not_repeated_for_cohorts(spark):
    """Only the weights are met with the cohorts' calendar before prices are joined, in as many tasks as asked for."""
    grid = spark.createDataFrame([(DAY + dt.timedelta(d), s, 10.0 + d * s) for d in range(6) for s in (1, 2)], "session date, security_id long, close double")
    weights = spark.createDataFrame([(p, DAY + dt.timedelta(d), s, 0.4) for p in (1, 2) for d in (0, 2) for s in (1, 2)], "p int, execution date, security_id long, weight double")
    dealt, plain = (pf.cohort_nav(grid, weights, by=("p",), parts=n) for n in (3, None))
    same(dealt, plain, ["p", "session"])
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [at#" in plan and "RepartitionByExpression [p#" in plan
    # between the prices and their join no row is multiplied: nothing but windows and projections lies under their shuffle
    prices = [i for i, line in enumerate(plan.splitlines()) if "RepartitionByExpression [at#" in line][1]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    under = [line for line in lines[prices + 1 :]]
    end = next((i for i, line in enumerate(under) if depth(line) <= depth(lines[prices])), len(under))
    assert not any("Join" in line for line in under[:end])
