"""Corporate actions, positions, fills and other account tables as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that fails where a key repeats on a side; the check is part of the plan."""
    def checked(df: DataFrame, side: str) -> DataFrame:
        n = df.groupBy(key).agg(F.count("*").alias("__n"))
        wrong = F.raise_error(F.concat(F.lit(f"NOT_ONE_TO_ONE: {side} repeats "), F.col(key).cast("string")))
        return n.select(key, F.when(F.col("__n") > 1, wrong.cast("boolean")).otherwise(F.lit(True)).alias(f"__{side}"))

    out = a.join(checked(a, "left"), key).where("__left").drop("__left")
    return out.join(b.join(checked(b, "right"), key).where("__right").drop("__right"), key, how)


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with whether BOTH tables have it, or LEFT_ONLY, RIGHT_ONLY."""
    both = a.select(key, F.lit(1).alias("__a")).join(b.select(key, F.lit(1).alias("__b")), key, "full_outer")
    return both.select(key, F.when(F.col("__a").isNull(), "RIGHT_ONLY").when(F.col("__b").isNull(), "LEFT_ONLY").otherwise("BOTH").alias("status"))


def visible_actions(actions: DataFrame, cutoff: Column) -> DataFrame:
    """Distinct actions that were known at the cutoff."""
    return actions.where(F.col("available_at") <= cutoff).distinct()


def split_shares(positions: DataFrame, splits: DataFrame) -> DataFrame:
    """Shares after the splits that came after each position's date, and whether they are whole.

    Positions: security_id, shares, at. Splits: security_id, ratio, effective_at. Positions and splits are one sequence read
    backwards, with a running product of ratios.
    """
    rows = positions.select("security_id", "at", F.lit(1).alias("__kind"), F.lit(1.0).alias("__ratio"), F.struct(*positions.columns).alias("__row"))
    cuts = splits.select("security_id", F.col("effective_at").alias("at"), F.lit(0).alias("__kind"), F.col("ratio").cast("double").alias("__ratio"))
    later = Window.partitionBy("security_id").orderBy(F.desc("at"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(cuts, allowMissingColumns=True).withColumn("__ratio", F.product("__ratio").over(later)).where("__kind = 1")
    out = both.select("__row.*", "__ratio").withColumn("shares", F.col("shares") * F.col("__ratio")).drop("__ratio")
    return out.withColumn("whole", F.col("shares") == F.floor("shares"))


def equity(positions: DataFrame, dividends: DataFrame, terminal: DataFrame, cash: Column, at: Column) -> DataFrame:
    """One row (receivable, positions, equity): cash, marked positions and dividends between ex date and payment.

    Positions (security_id, shares, mark, since) held since the ex date's morning or before it are entitled; what was bought on
    or after that date is not.
    """
    rows = positions.join(dividends, "security_id", "left").join(terminal, "security_id", "left")
    entitled = (F.col("since") < F.col("ex_date")) & (F.col("ex_date") <= at) & (at < F.col("pay_date"))
    due = F.when(entitled, F.col("shares") * F.col("amount")).otherwise(0.0)
    held = F.col("shares") * F.coalesce("terminal_value", "mark")
    return rows.agg(F.sum(due).alias("receivable"), F.sum(held).alias("positions")).select("receivable", "positions", (cash + F.col("positions") + F.col("receivable")).alias("equity"))


def quote_reasons(quotes: DataFrame, now: Column, feed: str, max_age_seconds: int, max_skew_seconds: int) -> DataFrame:
    """Each security with the reasons against its quotes, in order and once each (security_id, reasons); none if empty.

    Quotes: security_id, seq (their order), bid, ask, quote_time, received_at, feed, delayed, currency, session, halted. What is
    unknown counts against a quote. All of a security's quotes count, and more than one is a reason by itself; if quote times
    of all securities lie too far apart, each of them has a reason more.
    """
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 1e6
    bid, ask, quoted, got = (F.col(c) for c in ("bid", "ask", "quote_time", "received_at"))
    no_price = bid.isNull() | ask.isNull() | F.isnan(bid) | F.isnan(ask) | (F.abs(bid) == float("inf")) | (F.abs(ask) == float("inf"))
    timed = quoted.isNotNull() & got.isNotNull()
    skew = quotes.agg(seconds(F.min(F.when(timed, quoted)), F.max(F.when(timed, quoted))).alias("__skew"))  # one row
    faults = {
        "CROSSED_OR_INVALID_QUOTE": ~no_price & ~((bid > 0) & (bid <= ask)), "INVALID_QUOTE": no_price, "QUOTE_TIME_ORDER": timed & ~((quoted <= got) & (got <= now)), "STALE_QUOTE": timed & (seconds(quoted, now) > max_age_seconds),
        "UNKNOWN_QUOTE_TIME": ~timed, "FEED_MISMATCH": ~F.coalesce(F.col("feed") == feed, F.lit(False)) | (F.col("feed") == ""), "DELAYED_OR_UNKNOWN_FEED": F.coalesce("delayed", F.lit(True)),
        "INVALID_CURRENCY_OR_SESSION": ~F.coalesce((F.col("currency") == "USD") & (F.col("session") == "REGULAR"), F.lit(False)), "HALTED_OR_UNKNOWN": F.coalesce("halted", F.lit(True))}
    seen = quotes.groupBy("security_id").agg(F.count("*").alias("n"), *(F.bool_or(f).alias(name) for name, f in faults.items()))
    seen = seen.join(F.broadcast(skew))
    told = {"DUPLICATE_QUOTE": F.col("n") > 1} | {name: F.col(name) for name in faults} | {"QUOTE_SKEW": F.col("__skew") > max_skew_seconds}
    return seen.select("security_id", F.array_compact(F.array(*(F.when(f, name) for name, f in told.items()))).alias("reasons"))


def imported_fills(fills: DataFrame) -> DataFrame:
    """Positions and cash per account; a fill that comes again counts once."""
    once = fills.dropDuplicates(["fill_id"])
    return once.groupBy("account").agg(F.count("*").alias("n_fills"), F.sum("quantity").cast("long").alias("position"), F.sum(-F.col("quantity") * F.col("price")).alias("cash"))


def exposures(windows: DataFrame, key: str, width: int = 30) -> DataFrame:
    """Pairs (a, b) of windows [s, t) of one key that meet in time and scope; ``*`` is every scope.

    Time is cut into stretches of ``width`` days, and only windows that share a stretch are compared: a pair is made in the
    first stretch that both have, so once. Windows that are empty or lack a bound meet none.
    """
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width)
    cut = windows.where("s < t").withColumn("__first", number(F.col("s")))
    cut = cut.withColumn("__at", F.explode(F.sequence("__first", number(F.date_sub("t", 1)))))
    a, b = (cut.select(key, "__at", F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("t").alias(f"t{x}"), F.col("scope").alias(f"scope{x}"), F.col("__first").alias(f"f{x}")) for x in "ab")
    everything = F.array_contains("scopea", "*") | F.array_contains("scopeb", "*")
    met = (F.col("a") < F.col("b")) & (F.col("sa") < F.col("tb")) & (F.col("sb") < F.col("ta")) & (F.col("__at") == F.greatest("fa", "fb"))
    return a.join(b, [key, "__at"]).where(met & (everything | F.arrays_overlap("scopea", "scopeb")))
