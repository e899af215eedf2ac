"""Times of exchange sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "America/New_York"


def to_utc(local: Column, zone: str = ZONE) -> Column:
    """A local time without zone as UTC, by the zone's rules for that day (daylight saving too)."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))


def to_local(utc: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def _at(day: Column, hour: int, minute: int) -> Column:
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(minute), F.lit(0))


def session_bounds(calendar: DataFrame, opens: tuple[int, int] = (9, 30), closes: tuple[int, int] = (16, 0), early: tuple[int, int] = (13, 0)) -> DataFrame:
    """The calendar (session, early) with ``open_at`` and ``close_at`` in UTC; ``early`` sessions close at the early time."""
    day = F.col("session")
    close = F.when(F.coalesce("early", F.lit(False)), _at(day, *early)).otherwise(_at(day, *closes))
    return calendar.withColumns({"open_at": to_utc(_at(day, *opens)), "close_at": to_utc(close)})


def bounds_of(asked: DataFrame, calendar: DataFrame) -> DataFrame:
    """Days asked for (session, ...) with their bounds; a day that is no session has none and the status NOT_A_SESSION.

    The calendar is a dimension of a few thousand rows.
    """
    bounds = session_bounds(calendar).select("session", "open_at", "close_at")
    status = F.when(F.col("open_at").isNull(), "NOT_A_SESSION").otherwise("SESSION")
    return asked.join(F.broadcast(bounds), "session", "left").withColumn("status", status)
