"""Audits and roll-ups of panels, trades, snapshots and registries, each one aggregate (or one window and one aggregate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc


def field_coverage(rows: DataFrame, session: str = "available_at") -> DataFrame:
    """For each field its rows, securities, sessions and the share of values that are finite."""
    return rows.groupBy("field").agg(F.count("*").alias("n_rows"), F.count_distinct("security_id").alias("securities"), F.count_distinct(session).alias("sessions"), F.avg(sc.is_finite(F.col("value")).cast("double")).alias("finite"))


def coverage_counts(requested: DataFrame, processed: DataFrame, key: str, eligible: Column) -> DataFrame:
    """One row: how many were asked for, are eligible, excluded (not eligible, or unknown), and eligible and processed."""
    rows = requested.join(processed.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    good = F.coalesce(eligible, F.lit(False))
    return rows.agg(F.count("*").alias("requested"), F.count_if(good).alias("eligible"), F.count_if(~good).alias("excluded"), F.count_if(good & F.col("__done").isNotNull()).alias("processed"))


def calendar_returns(values: DataFrame, value: str) -> DataFrame:
    """(year, change): each year's last value over the year before's, the first year over its own first value."""
    y = values.groupBy(F.year("session").alias("year")).agg(F.max_by(value, "session").alias("v"), F.min_by(value, "session").alias("f"))
    before = F.coalesce(F.lag("v").over(Window.orderBy("year")), "f")  # one row for each year
    return y.select("year", (F.try_divide("v", before) - 1).alias("change"))


def trade_totals(trades: DataFrame, *by: str) -> DataFrame:
    """Notional, gross and half turnover over ``nav``, fees and change of cash of trades (side, notional, fee, nav)."""
    x, sells = F.col("notional"), F.col("side") == "SELL"
    one = trades.groupBy(*by).agg(F.sum(x).alias("notional"), F.sum("fee").alias("fees"), F.sum(F.when(sells, x).otherwise(-x) - F.coalesce("fee", F.lit(0.0))).alias("cash_change"), F.max("nav").alias("__nav"))
    gross = F.try_divide(F.col("notional"), F.col("__nav"))
    return one.withColumns({"gross_turnover": gross, "half_turnover": gross / 2}).drop("__nav")


def time_weighted(snapshots: DataFrame, order: str = "at") -> DataFrame:
    """(account, total): the chained return of snapshots (account, at, pre, post, flow).

    A step is ((pre - flow) / the snapshot before's pre) * (post / pre); an account's first snapshot only has its post / pre.
    Steps over zero or without a value count as one.
    """
    last = F.lag("pre").over(Window.partitionBy("account").orderBy(order))
    r = snapshots.withColumn("__f", F.coalesce(F.try_divide(F.col("pre") - F.col("flow"), last), F.lit(1.0)) * F.coalesce(F.try_divide("post", "pre"), F.lit(1.0)))
    return r.groupBy("account").agg((F.product("__f") - 1).alias("total"))


def registry_rollup(definitions: DataFrame) -> DataFrame:
    """For each id its rows, different definitions (by ``hash``), whether they conflict, and how many are safe and complete."""
    n = F.count_distinct("hash")
    return definitions.groupBy("id").agg(F.count("*").alias("n"), n.alias("definitions"), (n > 1).alias("conflicting"), F.count_if("safe").alias("safe"), F.count_if("complete").alias("complete"))


def field_demand(needs: DataFrame, supported: DataFrame) -> DataFrame:
    """For each definition and provider the fields it needs, those that are supported, and whether it is a candidate (all are).

    ``needs`` has definition_id, field; ``supported`` has provider, field. Providers are few, their fields any number.
    """
    providers = F.broadcast(supported.select("provider").distinct())
    known = supported.select("provider", "field").distinct().withColumn("__has", F.lit(True))
    rows = needs.distinct().join(providers).join(known, ["provider", "field"], "left")
    out = rows.groupBy("definition_id", "provider").agg(F.count("*").alias("needed"), F.count("__has").alias("supported"))
    return out.withColumn("candidate", F.col("needed") == F.col("supported"))


def reason_histogram(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """How often each reason occurs in an array column; what follows a colon is detail."""
    return rows.select(F.explode(reasons).alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def lineage(panel: DataFrame, versions: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Panel rows with the status of their source: MISSING, DIFFERENT (beyond a relative tolerance) or SAME."""
    found = versions.select(*keys, F.col("value").alias("source"), F.lit(True).alias("__known"))
    off = F.abs(F.col("value") - F.col("source")) > tolerance * F.greatest(F.lit(1.0), F.abs("source"))
    same = F.coalesce(~off, F.col("value").isNull() & F.col("source").isNull())
    return panel.join(found, keys, "left").withColumn("lineage", F.when(F.col("__known").isNull(), "MISSING").when(same, "SAME").otherwise("DIFFERENT")).drop("__known")
