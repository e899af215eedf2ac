"""Market observables of bars, indices of a universe, and labels of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.functions import timeseries as ts
from tidepanel.operators.asof import next_at


def observables(grid: DataFrame, windows: tuple[int, ...] = (30, 60, 120)) -> DataFrame:
    """The grid with returns, adv20, historical_volatility_{windows} (population, not annualised), true_range, atr14 and
    range_over_atr20. All frames share one partitioning and order, so they cost one shuffle."""
    out = grid.withColumns({"returns": ts.ts_change(F.col("close")), "last_close": ts.ts_delay(F.col("close"), 1)})
    out = out.withColumn("true_range", sc.true_range(F.col("high"), F.col("low"), F.col("last_close"))).drop("last_close")
    volatility = {f"historical_volatility_{n}": ts.ts_std_dev(F.col("returns"), n) for n in windows}
    out = out.withColumns({"adv20": ts.ts_mean(F.col("volume"), 20), "atr14": ts.ts_mean(F.col("true_range"), 14), "atr20": ts.ts_mean(F.col("true_range"), 20)} | volatility)
    return out.withColumn("range_over_atr20", sc.divide(F.col("true_range"), F.col("atr20"))).drop("atr20")


def universe_index(grid: DataFrame, benchmark: object) -> DataFrame:
    """(session, index, benchmark): the compounded mean change of all securities that have one, and the benchmark's close over its
    first one. Sessions are a calendar, so the last step is small."""
    rows = grid.withColumn("change", sc.finite(ts.ts_change(F.col("close"))))
    by = rows.groupBy("session").agg(F.avg(F.when(F.col("security_id") != benchmark, F.col("change"))).alias("change"), F.max(F.when(F.col("security_id") == benchmark, F.col("close"))).alias("close"))
    upto = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("session", F.product(1 + F.coalesce("change", F.lit(0.0))).over(upto).alias("index"), F.try_divide("close", F.first("close", ignorenulls=True).over(upto)).alias("benchmark"))


def trade_labels(signals: DataFrame, prices: DataFrame, sessions: DataFrame, horizon: int) -> DataFrame:
    """Signals (security_id, cutoff, ...) with entry and exit sessions, forward_return and label_status.

    Entry is the first session strictly after the cutoff, exit ``horizon`` sessions later; the label is known at the exit.
    INSUFFICIENT_FUTURE_DATA without an exit, INVALID_PRICE where the entry isn't above zero or the exit is below it or
    missing, else AVAILABLE. Sessions and distinct cutoffs are dates, which small tables number; prices are met by equal keys.
    """
    if horizon < 1:
        raise ValueError("INVALID_HORIZON")
    order = Window.orderBy("session")
    calendar = sessions.select("session").distinct().withColumns({"exit": F.lead("session", horizon).over(order), "k": F.lit(1)})
    cutoffs = signals.select("cutoff").distinct().withColumn("k", F.lit(1))
    found = next_at(calendar.select("session", "k"), cutoffs, ["k"], "session", "cutoff").select("cutoff", F.col("next_session").alias("entry"))
    found = found.join(calendar.select(F.col("session").alias("entry"), "exit"), "entry", "left")
    out = signals.join(F.broadcast(found), "cutoff")
    for name in ("entry", "exit"):
        out = out.join(prices.select("security_id", F.col("session").alias(name), F.col("price").alias(f"{name}_price")), ["security_id", name], "left")
    good = F.coalesce((F.col("entry_price") > 0) & (F.col("exit_price") >= 0) & sc.is_finite(F.col("entry_price")) & sc.is_finite(F.col("exit_price")), F.lit(False))
    status = F.when(F.col("exit").isNull(), "INSUFFICIENT_FUTURE_DATA").when(~good, "INVALID_PRICE").otherwise("AVAILABLE")
    shown = [F.when(F.col("exit").isNotNull(), F.col(c)).alias(c) for c in ("entry", "exit")]
    return out.select(*signals.columns, *shown, F.when(status == "AVAILABLE", F.col("exit_price") / F.col("entry_price") - 1).alias("forward_return"), status.alias("label_status"))
