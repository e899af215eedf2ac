"""As-of selection: what was known at a time.

The core is one running maximum. Availability only grows, so the best version known at a session is the running maximum of
(precedence, payload) over versions in order of availability. Versions and sessions are put into one sequence; nothing is
joined by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], precedence: Sequence[Column], known: Column | None = None, parts: int | None = None) -> DataFrame:
    """The row of each key that comes first by ``precedence`` (descending), among those ``known``.

    A latest row whose value is NULL stays: there is no fall back to an older one. ``parts`` is the number of tasks that the
    keys are dealt to, Spark's own if None.
    """
    rows = rows if known is None else rows.where(known)
    rows = rows if parts is None else rows.repartition(parts, *keys)
    order = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(p) if isinstance(p, str) else p.desc_nulls_last() for p in precedence))
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def as_of(events: DataFrame, sessions: DataFrame, keys: Sequence[str], known_at: str, precedence: Sequence[str], payload: Sequence[str], session: str = "session") -> DataFrame:
    """For each row of ``sessions`` (keys and session) the best version known by then, or NULLs.

    ``known_at`` and ``session`` have one type; a version known at a session counts for it. One shuffle and one sort.
    """
    packed = F.struct(*(F.col(c) for c in (*precedence, *payload)))
    rows = events.select(*keys, F.col(known_at).alias("__at"), F.lit(0).alias("__kind"), packed.alias("__version"), F.lit(None).cast(sessions.schema[session].dataType).alias(session))
    marks = sessions.select(*keys, F.col(session).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.schema["__version"].dataType).alias("__version"), session)
    run = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("__best", F.max("__version").over(run)).where("__kind = 1")
    return both.select(*keys, session, *(F.col(f"__best.{c}").alias(c) for c in dict.fromkeys((*precedence, *payload))))


def label_panel(panel: DataFrame, labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """The panel with each security's labels as known at the session."""
    events = labels.withColumn("__known", F.greatest("effective_at", "available_at"))
    found = as_of(events, panel.select("security_id", "session"), ["security_id"], "__known", ["effective_at", "available_at"], list(names))
    return panel.join(found.select("security_id", "session", *names), ["security_id", "session"])


def pit_panel(versions: DataFrame, calendar: DataFrame, keys: Sequence[str], known_at: str = "available_at", precedence: Sequence[str] = ("period_end", "available_at", "accession"), payload: Sequence[str] = ("value",)) -> DataFrame:
    """The daily point-in-time panel: for each key and session the version with the latest period, then the latest word on it.

    ``calendar`` has the column session. Sessions before the first version have no row.
    """
    sessions = F.broadcast(calendar.agg(F.sort_array(F.collect_set("session")).alias("__all")))
    grid = versions.select(*keys).distinct().join(sessions).select(*keys, F.explode("__all").alias("session"))
    found = as_of(versions, grid, keys, known_at, precedence, payload)
    return found.where(F.col(precedence[0]).isNotNull())


def next_at(times: DataFrame, asked: DataFrame, key: Sequence[str], time: str, at: str, strictly: bool = True) -> DataFrame:
    """``asked`` with the first ``time`` after its ``at`` (or at it), by key; one sequence read backwards."""
    marks = times.select(*key, F.col(time).alias("__at"), F.lit(0 if strictly else 1).alias("__kind"), F.col(time).alias("__time"), F.lit(None).cast(asked.select(F.struct(*asked.columns)).schema[0].dataType).alias("__row"))
    rows = asked.select(*key, F.col(at).alias("__at"), F.lit(1 if strictly else 0).alias("__kind"), F.lit(None).cast(times.schema[time].dataType).alias("__time"), F.struct(*asked.columns).alias("__row"))
    order = Window.partitionBy(*key).orderBy(F.desc("__at"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("__next", F.last("__time", ignorenulls=True).over(order)).where("__row is not null")
    return both.select("__row.*", F.col("__next").alias(f"next_{time}"))


def mapped(facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Facts with the one best binding of the catalogue for their tag, unit and filing date, or the reason for none.

    Catalogue rows: tag, issuer (NULL: any), unit, valid_from, valid_to, priority, field. Facts: fact_id, tag, issuer, unit, filed,
    and perhaps dimension: a fact of a part of the issuer (a dimension that is not blank) is deferred whatever its tag.
    """
    part = F.trim(F.coalesce(F.col("dimension").cast("string"), F.lit(""))) != "" if "dimension" in facts.columns else F.lit(False)
    facts = facts.withColumn("of_part", part)
    c = F.broadcast(catalogue.select(*(F.col(x).alias(f"c_{x}") for x in catalogue.columns)))
    tagged = facts.join(c, F.col("tag") == F.col("c_tag"), "left")
    fits = (F.col("c_issuer").isNull() | (F.col("c_issuer") == F.col("issuer"))) & (F.col("filed") >= F.col("c_valid_from")) & (F.col("c_valid_to").isNull() | (F.col("filed") <= F.col("c_valid_to")))
    tagged = tagged.withColumns({"in_range": F.coalesce(fits, F.lit(False)), "same_unit": F.coalesce(F.col("c_unit") == F.col("unit"), F.lit(False))})
    good = F.col("in_range") & F.col("same_unit")
    best = F.min(F.when(good, F.col("c_priority"))).over(Window.partitionBy("fact_id"))
    tagged = tagged.withColumn("is_best", good & (F.col("c_priority") == best))
    out = tagged.groupBy("fact_id").agg(
        F.count_if("is_best").alias("n_best"), F.first(F.when(F.col("is_best"), F.col("c_field")), ignorenulls=True).alias("field"),
        F.bool_or(F.col("c_tag").isNotNull()).alias("known_tag"), F.bool_or("in_range").alias("any_range"), F.bool_or("of_part").alias("of_part"))
    status = F.when(F.col("of_part"), "DEFERRED_DIMENSION").when(F.col("n_best") == 1, "MAPPED").when(F.col("n_best") > 1, "DEFERRED_SEMANTIC_AMBIGUITY").when(~F.col("known_tag"), "DEFERRED_CUSTOM_TAG").when(F.col("any_range"), "DEFERRED_UNIT_OR_BASIS").otherwise("DEFERRED_SEMANTIC")
    return out.select("fact_id", F.when((F.col("n_best") == 1) & ~F.col("of_part"), F.col("field")).alias("field"), status.alias("status"))


def overlapping(intervals: DataFrame, key: str, member: str, start: str, end: str) -> DataFrame:
    """Rows with a flag: whether another member of the key overlaps [start, end) in time.

    Each member has one interval, which is not empty. In order of start, one overlaps another before it if the latest end so
    far is after its start, and one after it if the next start is before its end; no pairs are made.
    """
    order = Window.partitionBy(key).orderBy(start, member)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col(start)
    after = F.lead(start).over(order) < F.col(end)
    return intervals.withColumn("ambiguous", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
