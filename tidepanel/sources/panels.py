"""Bars from raw events and line items, and the dense grid of sessions and securities.

Windows count sessions, not observations, so every security has a row in every session; a session without a bar has NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")
#: The security that plays the benchmark in weekly panels.
BENCHMARK = 1
#: About how many rows a shuffle deals to one task.
TASK_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame) -> int:
    """How many tasks a shuffle of these rows, or of rows made of them, goes to: one for each ``TASK_ROWS``, so that a task's
    memory stays the same as the input grows. Counting the rows of a file reads its footer only."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def bars(rows: DataFrame, session: Column, security: Column, price: Column, order: Column, volume: Column, amount: Column | None = None, parts: int | None = None) -> DataFrame:
    """One row for each session and security: first, highest, lowest and last price by ``order``, and summed volume.

    With ``amount``, also the volume-weighted price. All are aggregates with partial sums before the shuffle; with ``parts``,
    rows are dealt to so many tasks by security before, and windows by security need no further shuffle.
    """
    plain = rows.select(session.alias("session"), security.alias("security_id"), price.alias("price"), order.alias("order"), volume.alias("volume"), (amount if amount is not None else F.lit(None).cast("double")).alias("amount"))
    if parts is not None:
        plain = plain.repartition(parts, "security_id")
    out = plain.groupBy(*(("session", "security_id") if parts is None else ("security_id", "session"))).agg(
        F.min_by("price", "order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order").alias("close"),
        F.sum("volume").alias("volume"), F.try_divide(F.sum("amount"), F.sum("volume")).alias("vwap"))
    return out if amount is not None else out.drop("vwap")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of users."""
    e = read(spark, sf_dir, "events")
    return bars(e, F.to_date("ts"), F.col("user_id"), F.col("value"), F.struct("ts", "event_id"), F.lit(1).cast("long"))


def supplier_bars(spark: SparkSession, sf_dir: str, unit: str = "week", parts: int | None = None) -> DataFrame:
    """Bars of suppliers' unit prices by week or day."""
    li = read(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate") if unit == "day" else F.to_date(F.date_trunc(unit, "l_shipdate"))
    price = F.try_divide("l_extendedprice", "l_quantity")
    return bars(li, day, F.col("l_suppkey"), price, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), F.col("l_quantity"), F.col("l_extendedprice"), parts)


def supplier_sessions(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The calendar of supplier bars, read off one column."""
    day = F.to_date("l_shipdate") if unit == "day" else F.to_date(F.date_trunc(unit, "l_shipdate"))
    return read(spark, sf_dir, "lineitem").select(day.alias("session")).distinct()


def densify(rows: DataFrame, sessions: DataFrame | None = None, securities: DataFrame | None = None) -> DataFrame:
    """The grid of all sessions and securities with the bars where there are any.

    Sessions are a calendar: a few thousand dates at most, which each security takes as an array. ``sessions`` gives the
    calendar and ``securities`` the ids; without them, they are read off the rows, which computes those again.
    """
    calendar = (rows if sessions is None else sessions).select("session").distinct().agg(F.sort_array(F.collect_set("session")).alias("sessions"))
    securities = (rows if securities is None else securities).select("security_id").distinct()
    cells = securities.join(F.broadcast(calendar)).select(F.explode("sessions").alias("session"), "security_id")
    return cells.join(rows, ["session", "security_id"], "left")


def filled_grid(rows: DataFrame, sessions: DataFrame, *fields: str) -> DataFrame:
    """The grid of ``densify`` from bars that are dealt by security, without a join: each bar gives its own session and the empty
    ones up to the security's next bar, the first one also those before it. Bars without a session fill no cell."""
    calendar = F.broadcast(sessions.select("session").distinct().agg(F.sort_array(F.collect_set("session")).alias("sessions")))
    w = Window.partitionBy("security_id").orderBy("session")
    at = rows.join(calendar).select("security_id", "session", *fields, F.array_position("sessions", F.col("session")).alias("__at"), F.size("sessions").alias("__n"))
    at = at.withColumns({"__from": F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("__at")), "__to": F.coalesce(F.lead("__at").over(w), F.col("__n") + 1) - 1})
    cells = at.select("security_id", *fields, "__at", F.explode(F.when(F.col("__from") <= F.col("__to"), F.sequence("__from", "__to"))).alias("__i"))
    return cells.join(calendar).select(F.get("sessions", F.col("__i").cast("int") - 1).alias("session"), "security_id", *(F.when(F.col("__i") == F.col("__at"), F.col(f)).alias(f) for f in fields))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return densify(event_bars(spark, sf_dir), e.select(F.to_date("ts").alias("session")), e.select(F.col("user_id").alias("security_id")))


def supplier_grid(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("security_id"))
    return densify(supplier_bars(spark, sf_dir, unit), supplier_sessions(spark, sf_dir, unit), ids)


def weekly_panel(spark: SparkSession, sf_dir: str, benchmark: int = BENCHMARK) -> DataFrame:
    """The weekly supplier grid with the last known open and close, volume (0 without trades) and traded (NULL without).

    The supplier that plays the benchmark is left out of the cross-section. Line items are dealt by supplier once; bars, grid and
    all windows by security after it keep that partitioning.
    """
    from tidepanel.functions.timeseries import forward_fill

    bars_of = supplier_bars(spark, sf_dir, parts=tasks(read(spark, sf_dir, "lineitem"))).where(F.col("security_id") != benchmark)
    grid = filled_grid(bars_of, supplier_sessions(spark, sf_dir), "open", "close", "volume")
    return grid.select("session", "security_id", forward_fill(F.col("open")).alias("open"), forward_fill(F.col("close")).alias("close"), F.coalesce("volume", F.lit(0.0)).cast("double").alias("volume"), F.col("volume").cast("double").alias("traded"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label history of suppliers: sector (region) and industry (nation), and for every third supplier a later change."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    base = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    first = base.select(F.col("s_suppkey").alias("security_id"), F.to_date(F.lit("1990-01-01")).alias("effective_at"), F.to_date(F.lit("1990-01-02")).alias("available_at"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))
    later = base.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("security_id"), F.to_date(F.lit("1998-01-01")).alias("effective_at"), F.to_date(F.lit("1998-02-01")).alias("available_at"), F.lit("MOVED").alias("sector"), F.col("n_name").alias("industry"))
    return first.unionByName(later)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts: a supplier's value per return flag and month of order, known from shipping on.

    Line items and orders meet by order in as many tasks as line items ask for; facts are of one order, so they stay there.
    """
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    parts = tasks(li)
    rows = li.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey"), li.l_orderkey == o.o_orderkey)
    return rows.groupBy(F.col("l_suppkey").alias("security_id"), F.col("l_returnflag").alias("field"), F.last_day("o_orderdate").alias("period_end"), F.col("o_orderkey").alias("accession")).agg(
        F.max(F.to_date("l_shipdate")).alias("available_at"), F.sum("l_extendedprice").alias("value"))


def finite_fields(grid: DataFrame, *fields: str) -> DataFrame:
    """NaN and infinities of the fields become NULL."""
    from tidepanel.functions.scalar import finite

    return grid.withColumns({f: finite(F.col(f)) for f in fields})


#: The same tables in DuckDB's SQL, as parts of a WITH.
SQL_EVENTS = """bars_e AS (SELECT CAST(ts AS DATE) AS session, user_id AS security_id, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
grid_e AS (SELECT s.session, i.security_id, open, high, low, close, volume FROM (SELECT DISTINCT session FROM bars_e) s
  CROSS JOIN (SELECT DISTINCT security_id FROM bars_e) i LEFT JOIN bars_e b ON b.session = s.session AND b.security_id = i.security_id)"""
SQL_SUPPLIERS = """bars_l AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS session, l_suppkey AS security_id,
  first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap FROM lineitem GROUP BY 1, 2),
grid_l AS (SELECT s.session, i.security_id, open, high, low, close, volume, vwap FROM (SELECT DISTINCT session FROM bars_l) s
  CROSS JOIN (SELECT DISTINCT security_id FROM bars_l) i LEFT JOIN bars_l b ON b.session = s.session AND b.security_id = i.security_id)"""
SQL_WEEKLY = f"""{SQL_SUPPLIERS}, week_l AS (SELECT session, security_id, last_value(open IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS open,
  last_value(close IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS close, coalesce(volume, 0)::DOUBLE AS volume, volume::DOUBLE AS traded FROM grid_l WHERE security_id <> {BENCHMARK})"""
SQL_LABELS = """labels_l AS (SELECT s_suppkey AS security_id, DATE '1990-01-01' AS effective_at, DATE '1990-01-02' AS available_at, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_suppkey, DATE '1998-01-01', DATE '1998-02-01', 'MOVED', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0)"""
SQL_VERSIONS = """versions_l AS (SELECT l_suppkey AS security_id, l_returnflag AS field, last_day(CAST(o_orderdate AS DATE)) AS period_end, o_orderkey AS accession,
  CAST(max(l_shipdate) AS DATE) AS available_at, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)"""
