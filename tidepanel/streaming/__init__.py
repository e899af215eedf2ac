"""Streaming forms of bars and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import utc_date


def stream_bars(events: DataFrame, late: str = "1 day", unit: str = "1 day") -> DataFrame:
    """Session bars of an event stream (ts, event_id, user_id, value); sessions are days of UTC, rows later than ``late`` are dropped."""
    order = F.struct("ts", "event_id")
    out = events.withWatermark("ts", late).groupBy(F.window("ts", unit), "user_id").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    return out.select(utc_date(F.col("window.start")).alias("session"), F.col("user_id").alias("security_id"), "open", "high", "low", "close", "volume")


def stream_fills(fills: DataFrame, late: str = "1 day") -> DataFrame:
    """Fills of a stream (fill_id, ts, ...) once each within the watermark."""
    return fills.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fill_id"])


def routing_calendar(sessions: DataFrame, close_hour: int = 16) -> DataFrame:
    """A row for each day from the first session to the last (day, close_at, next_session): the close is NULL on days without
    a session, the next session is the first one after the day.

    Days are few; they are numbered in one small sequence.
    """
    days = sessions.agg(F.min("session").alias("a"), F.max("session").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    rows = days.join(sessions.select(F.col("session").alias("day"), F.lit(True).alias("is_session")).distinct(), "day", "left")
    after = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    close = F.when(F.col("is_session"), F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(close_hour)))
    return rows.select("day", close.alias("close_at"), F.last(F.when(F.col("is_session"), F.col("day")), ignorenulls=True).over(after).alias("next_session"))


def route_late(revisions: DataFrame, calendar: DataFrame, within: int = 14) -> DataFrame:
    """A stream of revisions (available_at) with the session that may use each: its own day up to the close, else the next one,
    if that comes within so many days.

    ``calendar`` is a static dimension like that of ``routing_calendar``.
    """
    out = revisions.join(F.broadcast(calendar), F.to_date("available_at") == F.col("day"), "left")
    soon = F.when(F.col("next_session") <= F.date_add("day", within), F.col("next_session"))
    return out.withColumn("usable_session", F.when(F.col("available_at") <= F.col("close_at"), F.col("day")).otherwise(soon)).drop("day", "close_at", "next_session")


def first_seen(revisions: DataFrame, seen: str = "first_seen_at") -> DataFrame:
    """Revisions as a running process may use them: not before it saw them."""
    return revisions.withColumn("available_at", F.greatest("available_at", seen))
