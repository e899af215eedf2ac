"""Positions through dated events: trades, splits, dividends, delistings and outside cash, in one sequence a security.

A position after an event is the sum of all trades so far, each times the splits since: with running products P of ratios it
is P now times the running sum of shares over P then. A delisting ends a position; what follows begins a new sequence. No
account is walked through step by step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: On one day events come in this order, trades after them.
KINDS = ("split", "dividend_ex", "dividend_pay", "delisting", "trade")
_NEAR = 1e-10


def held(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Events with ``before`` and ``shares``, the position just before and after each, and ``status``.

    ``events``: security_id, at, kind, event_id, amount (shares of a trade, ratio of a split, cash per share of a dividend's ex
    date, value per share of a delisting), entitlement (of a dividend's payment: the event_id of its ex date). Status is
    FRACTIONAL_SPLIT_CASH_IN_LIEU_REQUIRED where a split leaves part of a share, INVALID_SPLIT for a ratio that is not above
    zero (it changes nothing), NEGATIVE_POSITION, TRADE_AFTER_DELISTING, or OK. ``parts`` is the number of tasks that securities
    are dealt to, Spark's own if None.
    """
    events = events if parts is None else events.repartition(parts, "security_id")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by = Window.partitionBy("security_id").orderBy("at", "order", "event_id")
    gone = F.sum(F.when(F.col("kind") == "delisting", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("order", order).withColumn("epoch", F.coalesce(gone, F.lit(0)))
    run = Window.partitionBy("security_id", "epoch").orderBy("at", "order", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    right = (F.col("kind") == "split") & (F.col("amount") > 0)
    rows = rows.withColumn("scale", F.product(F.when(right, F.col("amount")).otherwise(1.0)).over(run))
    bought = F.sum(F.when(F.col("kind") == "trade", F.col("amount") / F.col("scale")).otherwise(0.0)).over(run)
    rows = rows.withColumn("shares", bought * F.col("scale"))
    # what is whole but for rounding is whole
    whole = F.abs(F.col("shares") - F.round("shares")) <= _NEAR * F.greatest(F.lit(1.0), F.abs("shares"))
    rows = rows.withColumn("shares", F.when(whole, F.round("shares")).otherwise(F.col("shares")))
    rows = rows.withColumn("before", F.coalesce(F.lag("shares").over(Window.partitionBy("security_id", "epoch").orderBy("at", "order", "event_id")), F.lit(0.0)))
    status = (
        F.when((F.col("kind") == "split") & ~F.coalesce(right, F.lit(False)), "INVALID_SPLIT")
        .when((F.col("kind") == "trade") & (F.col("epoch") > 0), "TRADE_AFTER_DELISTING")
        .when((F.col("kind") == "split") & (F.col("shares") != F.round("shares")), "FRACTIONAL_SPLIT_CASH_IN_LIEU_REQUIRED")
        .when(F.col("shares") < 0, "NEGATIVE_POSITION")
        .otherwise("OK")
    )
    rows = rows.withColumn("status", status).withColumn("shares", F.when(F.col("kind") == "delisting", 0.0).otherwise(F.col("shares")))
    return rows.drop("order", "epoch", "scale")


def dividends(positions: DataFrame) -> DataFrame:
    """Entitlements of ``held`` events: (security_id, event_id, ex_at, holding, entitlement, pay_at, status).

    The holding is that of the ex date, before its trades; what is bought later earns nothing. Each entitlement is paid once, by
    its first payment: PAID, or RECEIVABLE without one. A payment before the ex date, of no entitlement or of one that is paid
    is UNKNOWN_OR_PAID_ENTITLEMENT, a dividend that is negative or no number is INVALID_DIVIDEND and entitles to nothing.
    """
    right = F.coalesce((F.col("amount") >= 0) & ~F.isnan("amount"), F.lit(False))
    is_ex = F.col("kind") == "dividend_ex"
    both = positions.where("kind in ('dividend_ex', 'dividend_pay')").select(
        "security_id", F.when(is_ex, F.col("event_id")).otherwise(F.col("entitlement")).alias("claim"), "at", F.when(is_ex, 0).otherwise(1).alias("is_pay"), "event_id",
        F.when(is_ex, F.col("before")).alias("holding"), F.when(is_ex & right, F.col("before") * F.col("amount")).alias("entitlement"))
    # claim by claim in order of time: an ex date and then its payments
    claim = Window.partitionBy("security_id", "claim")
    upto = claim.orderBy("at", "is_pay", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("ex", F.max(F.when(F.col("is_pay") == 0, F.struct("at", "holding", "entitlement"))).over(upto))
    may = (F.col("is_pay") == 1) & F.col("ex.entitlement").isNotNull()
    rows = rows.withColumn("pays", may & (F.sum(may.cast("int")).over(upto) == 1))
    rows = rows.withColumn("pay_at", F.min(F.when(F.col("pays"), F.col("at"))).over(claim))
    is_ex = F.col("is_pay") == 0
    status = F.when(is_ex & F.col("entitlement").isNull(), "INVALID_DIVIDEND").when(is_ex & F.col("pay_at").isNull(), "RECEIVABLE").when(is_ex, "PAID").when(F.col("pays"), "PAYMENT").otherwise("UNKNOWN_OR_PAID_ENTITLEMENT")
    return rows.select("security_id", "event_id", F.col("ex.at").alias("ex_at"), F.col("ex.holding").alias("holding"), F.col("ex.entitlement").alias("entitlement"), F.when(is_ex, F.col("pay_at")).otherwise(F.col("at")).alias("pay_at"), status.alias("status"))


def receivables(claims: DataFrame) -> DataFrame:
    """What is due on each date of an ex date or payment: (at, receivable), entitlements in [ex, pay).

    Changes are summed by date first; dates are a calendar, which one small sequence adds up.
    """
    due = claims.where("status in ('PAID', 'RECEIVABLE')")
    change = due.select(F.col("ex_at").alias("at"), F.col("entitlement").alias("change")).unionByName(due.where("pay_at is not null").select(F.col("pay_at").alias("at"), (-F.col("entitlement")).alias("change")))
    by_date = change.groupBy("at").agg(F.sum("change").alias("change"))
    return by_date.select("at", F.sum("change").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("receivable"))
