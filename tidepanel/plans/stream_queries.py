"""Streams over deliveries of the driver's tables, each stopped and started again between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import streaming
from tidepanel.functions.scalar import utc_date, utc_instant
from tidepanel.plans.registry import query, rounded
from tidepanel.sources.panels import read
from tidepanel.streaming.runs import in_starts

#: Deliveries by ten days of arrival; some rows come a day later, some nine days, which may be too late.
_PARTS, _DAYS = 3, 10
_ARRIVED = "CAST(ts AS DATE) + CASE WHEN event_id % 101 = 0 THEN 9 WHEN event_id % 17 = 0 THEN 1 ELSE 0 END"
_SQL_DELIVERED = f"""d AS (SELECT event_id, ts, user_id, value, least({_PARTS - 1}, ({_ARRIVED} - (SELECT CAST(min(ts) AS DATE) FROM events)) // {_DAYS}) AS part FROM events),
mark AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS at FROM d GROUP BY 1)"""


def _delivered(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    first = e.agg(F.to_date(F.min("ts")).alias("first"))  # one row
    delay = F.when(F.col("event_id") % 101 == 0, 9).when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    day = F.date_diff(F.date_add(utc_date(F.col("ts")), delay), F.col("first"))
    e = e.join(F.broadcast(first)).withColumn("ts", utc_instant(F.col("ts")))
    return e.withColumn("part", F.least(F.lit(_PARTS - 1), F.floor(day / _DAYS)).cast("int")).drop("first")


@query("st_01_session_bars", f"""WITH {_SQL_DELIVERED}, k AS (SELECT d.* FROM d JOIN mark USING (part) WHERE mark.at IS NULL OR CAST(ts AS DATE) + INTERVAL 1 DAY > mark.at)
SELECT CAST(ts AS DATE) AS session, user_id AS security_id, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM k
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM d) GROUP BY 1, 2""")
def st_01(spark, sf_dir):
    """Bars of closed sessions; a row whose session the watermark has closed before it came is left out."""
    return in_starts(_delivered(spark, sf_dir), streaming.stream_bars, _PARTS, "stream-bars")


_FILLS = f"""WITH o AS (SELECT o_orderkey AS fill_id, o_custkey AS account, o_orderdate AS ts, year(o_orderdate) - (SELECT year(min(o_orderdate)) FROM orders) AS y, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * (1 + o_orderkey % 9) AS quantity, o_totalprice AS price FROM orders),
d AS (SELECT *, least(1, (y + CASE WHEN fill_id % 50 = 0 THEN 4 ELSE 0 END) // 4) AS part FROM o UNION ALL SELECT *, 1 FROM o WHERE fill_id % 3 = 0),
mark AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 DAY AS at FROM d GROUP BY 1),
k AS (SELECT DISTINCT fill_id, account, quantity, price FROM d JOIN mark USING (part) WHERE mark.at IS NULL OR ts > mark.at)"""


@query("st_02_fills_once", f"{_FILLS} SELECT account, count(*) AS n_fills, CAST(sum(quantity) AS BIGINT) AS position, round(-sum(quantity * price), 2) + 0.0 AS cash FROM k GROUP BY 1")
def st_02(spark, sf_dir):
    """Positions and cash of fills that come in two deliveries, a third of them in both; each counts once, those later than the
    watermark don't."""
    o = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    first = o.agg(F.year(F.min("o_orderdate")).alias("first"))
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    rows = o.join(F.broadcast(first)).select(F.col("o_orderkey").alias("fill_id"), F.col("o_custkey").alias("account"), utc_instant(F.col("o_orderdate")).alias("ts"), (sign * (1 + F.col("o_orderkey") % 9)).alias("quantity"), F.col("o_totalprice").alias("price"), (F.col("y") - F.col("first")).alias("y"))
    late = F.when(F.col("fill_id") % 50 == 0, 4).otherwise(0)
    sent = rows.withColumn("part", F.least(F.lit(1), F.floor((F.col("y") + late) / 4)).cast("int")).drop("y")
    again = sent.where("fill_id % 3 = 0").withColumn("part", F.lit(1))
    fills = in_starts(sent.unionByName(again), lambda s: streaming.stream_fills(s, "30 days"), 2, "stream-fills")
    out = fills.groupBy("account").agg(F.count("*").alias("n_fills"), F.sum("quantity").cast("long").alias("position"), F.sum(-F.col("quantity") * F.col("price")).alias("cash"))
    return out.withColumn("cash", rounded(F.col("cash"), 2))


@query("st_03_late_routing", """WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5),
e AS (SELECT event_id, greatest(ts, ts + to_hours(CASE WHEN event_id % 7 = 0 THEN 30 ELSE 0 END)) AS t FROM events),
n AS (SELECT event_id, CAST(t AS DATE) AS d, t, (SELECT min(session) FROM s WHERE session > CAST(t AS DATE)) AS next FROM e)
SELECT event_id, CASE WHEN d IN (SELECT session FROM s) AND t <= d + INTERVAL 16 HOUR THEN d WHEN next <= d + 14 AND d BETWEEN (SELECT min(session) FROM s) AND (SELECT max(session) FROM s) THEN next END AS usable_session FROM n""")
def st_03(spark, sf_dir):
    """Events as revisions, seen at once or thirty hours later, with the session that may use each; sessions are weekdays that
    close at four."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("available_at"))
    sessions = e.select(F.to_date("available_at").alias("session")).distinct().where("dayofweek(session) between 2 and 6")
    calendar = streaming.routing_calendar(sessions)
    seen = F.col("available_at") + F.make_dt_interval(hours=F.when(F.col("event_id") % 7 == 0, 30).otherwise(0))
    sent = e.withColumns({"first_seen_at": seen, "part": (F.col("event_id") % 2).cast("int")})
    return in_starts(sent, lambda s: streaming.route_late(streaming.first_seen(s), calendar), 2, "stream-routes").select("event_id", "usable_session")
