"""Target weights, caps, whole shares, cohorts in return space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions import timeseries as ts


def top_n(scores: DataFrame, n: int, cash: float = 0.05, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """BUY for the n highest scores, equal weights beside cash; the rest is OUT with none."""
    place = cs.descending_place(F.col("score"), F.col("security_id"), *by)
    rows = scores.where("score is not null").withColumn("place", place)
    k = F.count_if(F.col("place") <= n).over(cs.across(*by))
    inside = F.col("place") <= n
    return rows.withColumns({"action": F.when(inside, "BUY").otherwise("OUT"), "weight": F.when(inside, (1 - cash) / k).otherwise(0.0)})


def capped_top(scores: DataFrame, fraction: float, cash: float, single_cap: float, sector_cap: float, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """The top fraction by score with equal weights under caps on names and sectors.

    As all base weights are equal, the greedy scan is two windows: each sector's first floor(cap / weight) names pass, and of
    those the first N are in. Money is decimal so that the floor is exact.
    """
    w = cs.across(*by)
    money = "decimal(20,10)"
    n = F.greatest(F.lit(1), F.floor(F.count("score").over(w) * F.lit(fraction)))
    rows = scores.where("score is not null and sector is not null").withColumn("n", n)
    rows = rows.withColumn("weight", F.least(F.lit(single_cap).cast(money), ((1 - F.lit(cash).cast(money)) / F.col("n").cast("decimal(10,0)")).cast(money)))
    rows = rows.withColumn("per_sector", F.floor(F.lit(sector_cap).cast(money) / F.col("weight")).cast("int"))
    order = (F.desc("score"), F.asc("security_id"))
    rows = rows.withColumn("in_sector", F.row_number().over(cs.across(*by, "sector").orderBy(*order)))
    rows = rows.withColumn("passes", F.col("in_sector") <= F.col("per_sector"))
    before = F.coalesce(F.sum(F.col("passes").cast("int")).over(cs.across(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    reason = F.when(F.col("before") >= F.col("n"), "OUTSIDE_TOP_N").when(~F.col("passes"), "SECTOR_CAP")
    return rows.withColumns({"reason": reason, "target_weight": F.when(reason.isNull(), F.col("weight")).otherwise(F.lit(0).cast(money))})


def benchmarks(eligible: DataFrame, sector_cap: float, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """Equal weights of all, and the same scaled down where a sector is over its cap."""
    rows = eligible.withColumn("equal", 1 / F.count("*").over(cs.across(*by)))
    total = F.sum("equal").over(cs.across(*by, "sector"))
    return rows.withColumn("matched", F.col("equal") * F.least(F.lit(1.0), sector_cap / total))


def whole_shares(targets: DataFrame, positions: DataFrame, quotes: DataFrame, nav: Column, fee: float = 0.001) -> DataFrame:
    """Rebalance intents: floor(weight * nav / price) against what is held; a missing side is none."""
    money = "decimal(20,6)"
    rows = targets.join(positions, "security_id", "full_outer").join(quotes, "security_id")
    rows = rows.withColumns({"weight": F.coalesce("target_weight", F.lit(0)).cast(money), "held": F.coalesce("shares", F.lit(0)).cast("long"), "price": F.col("price").cast(money)})
    target = F.floor(F.col("weight") * nav.cast("decimal(20,2)") / F.col("price")).cast("long")
    rows = rows.withColumn("target", target).withColumn("difference", F.col("target") - F.col("held"))
    side = F.when(F.col("difference") > 0, "BUY").when(F.col("difference") < 0, "SELL").otherwise("KEEP")
    notional = F.abs("difference") * F.col("price").cast("double")
    return rows.select("security_id", "held", "target", "difference", side.alias("side"), notional.alias("notional"), (notional * fee).alias("fee"))


def decile_weights(scores: DataFrame, signals: DataFrame, by: tuple[str, ...] = (), fraction: float = 0.1, cash: float = 0.05) -> DataFrame:
    """Target weights (by..., execution, security_id, weight) on the session after each signal: equal ones beside cash for the top
    fraction by score, 0 for every other name with a score, none without one."""
    place = cs.descending_place(F.col("score"), F.col("security_id"), *by, "session")
    w = cs.across(*by, "session")
    rows = scores.where("score is not null").withColumn("place", place)
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.count("*").over(w) * fraction, 9))))
    rows = rows.join(F.broadcast(signals.select("session", "execution")), "session").where("execution is not null")
    return rows.select(*by, "execution", "security_id", F.when(F.col("place") <= F.col("k"), (1 - cash) / F.col("k")).otherwise(0.0).alias("weight"))


def cohort_nav(grid: DataFrame, weights: DataFrame, fee: float = 0.001, sessions: DataFrame | None = None, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Net value per session of held cohorts: (by..., session, gross_return, turnover, nav), any number of portfolios in one plan.

    ``weights`` (by..., execution, security_id, weight) hold from their execution to the portfolio's next, drifting with each
    security's price (the last one known). A session's return is that of drifted weights; at an execution, half-open turnover
    is the sum of absolute differences between drifted and new weights, charged at ``fee``. This is a model in return space.
    ``sessions`` is the grid's calendar; without it the grid is read once more for it. With ``parts``, prices and cohorts are dealt
    to so many tasks. Weights, not prices, are repeated for the sessions of their cohort.
    """
    dealt = lambda rows, *keys: rows if parts is None else rows.repartition(parts, *keys)
    weights = weights.where("weight != 0")
    # executions are a calendar, so each session takes a portfolio's as an array: it belongs to the running cohort, and at an
    # execution also to the one that ends
    executions = weights.groupBy(*by).agg(F.sort_array(F.collect_set("execution")).alias("all"))
    done = F.size(F.filter("all", lambda e: e <= F.col("at")))
    calendar = (grid if sessions is None else sessions).select(F.col("session").alias("at")).distinct().join(F.broadcast(executions)).withColumn("done", done).where("done > 0")
    cohort = lambda i, until: F.struct(F.get("all", i).alias("execution"), until.alias("until"))
    ending = F.when((F.get("all", F.col("done") - 1) == F.col("at")) & (F.col("done") > 1), cohort(F.col("done") - 2, F.col("at")))
    belongs = calendar.select(*by, "at", F.explode(F.array_compact(F.array(cohort(F.col("done") - 1, F.get("all", F.col("done"))), ending))).alias("c")).select(*by, "at", "c.*")
    prices = grid.withColumn("price", ts.forward_fill(F.col("close"))).select(F.col("session").alias("at"), "security_id", "price")
    held = dealt(weights.join(F.broadcast(belongs), [*by, "execution"]), "at", "security_id").join(dealt(prices, "at", "security_id"), ["at", "security_id"])
    held = dealt(held, *by, "execution", "security_id")
    run = Window.partitionBy(*by, "execution", "security_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("value", F.col("weight") * F.coalesce(F.try_divide("price", F.first("price", ignorenulls=True).over(run)), F.lit(1.0)))
    # each cohort's worth of 1 put in: securities and cash
    worth = held.groupBy(*by, "execution", "at").agg((F.sum("value") + 1 - F.sum("weight")).alias("worth"))
    step = worth.withColumn("gross_return", F.try_divide("worth", F.lag("worth").over(Window.partitionBy(*by, "execution").orderBy("at"))) - 1)
    returns = step.where("gross_return is not null").select(*by, F.col("at").alias("session"), "gross_return")
    drifted = held.join(worth, [*by, "execution", "at"]).where("at = until").select(*by, F.col("at").alias("execution"), "security_id", F.try_divide("value", "worth").alias("was"))
    name = (*by, "execution", "security_id")
    moved = dealt(weights, *name).join(dealt(drifted, *name), list(name), "full_outer")
    turnover = moved.groupBy(*by, F.col("execution").alias("session")).agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("turnover"))
    rows = returns.join(turnover, [*by, "session"], "full_outer").select(*by, "session", F.coalesce("gross_return", F.lit(0.0)).alias("gross_return"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    upto = Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)  # one row per portfolio and session
    return rows.withColumn("nav", F.product((1 + F.col("gross_return")) * (1 - fee * F.col("turnover"))).over(upto))
