"""As-of and other joins, sets, sequences and account tables on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.functions import timeseries as ts
from tidepanel.operators import accounts as ac
from tidepanel.operators import asof
from tidepanel.operators import quality as dq
from tidepanel.operators import rollups as ru
from tidepanel.operators.fills import first_touch
from tidepanel.operators.ordering import places
from tidepanel.operators.portfolio import whole_shares
from tidepanel.operators.selection import deduplicated
from tidepanel.plans.registry import add, query, rounded
from tidepanel.sources import panels
from tidepanel.sources.panels import SQL_EVENTS, SQL_LABELS, SQL_SUPPLIERS, SQL_VERSIONS, read

CUT = "1998-06-30"


def _date(text: str):
    return F.lit(text).cast("date")


@query("join_01_latest_revision", f"""WITH {SQL_VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY security_id, field, period_end ORDER BY available_at DESC, accession DESC) AS k FROM versions_l WHERE available_at <= DATE '{CUT}' AND period_end <= DATE '{CUT}')
SELECT security_id, field, period_end, accession, available_at, round(value, 4) + 0.0 AS value FROM r WHERE k = 1""")
def join_01(spark, sf_dir):
    known = (F.col("available_at") <= _date(CUT)) & (F.col("period_end") <= _date(CUT))
    out = asof.latest(panels.versions(spark, sf_dir), ["security_id", "field", "period_end"], ["available_at", "accession"], known, panels.tasks(read(spark, sf_dir, "lineitem")))
    return out.select("security_id", "field", "period_end", "accession", "available_at", rounded(F.col("value"), 4).alias("value"))


@query("join_02_label_panel", f"""WITH {SQL_SUPPLIERS}, {SQL_LABELS} SELECT g.session, g.security_id, arg_max(sector, (effective_at, l.available_at)) AS sector, arg_max(industry, (effective_at, l.available_at)) AS industry
FROM grid_l g LEFT JOIN labels_l l ON l.security_id = g.security_id AND greatest(effective_at, l.available_at) <= g.session GROUP BY 1, 2""")
def join_02(spark, sf_dir):
    grid = panels.supplier_grid(spark, sf_dir).select("session", "security_id")
    return asof.label_panel(grid, panels.labels(spark, sf_dir), ["sector", "industry"]).select("session", "security_id", "sector", "industry")


@query("join_03_single_cutoff", f"WITH {SQL_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY effective_at DESC, available_at DESC) AS k FROM labels_l WHERE greatest(effective_at, available_at) <= DATE '{CUT}') SELECT security_id, sector, industry FROM r WHERE k = 1")
def join_03(spark, sf_dir):
    out = asof.latest(panels.labels(spark, sf_dir), ["security_id"], ["effective_at", "available_at"], F.greatest("effective_at", "available_at") <= _date(CUT))
    return out.select("security_id", "sector", "industry")


@query("join_04_pit_panel", f"""WITH {SQL_VERSIONS}, cal AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS session FROM lineitem)
SELECT v.security_id, v.field, session, max(period_end) AS period_end, arg_max(accession, (period_end, v.available_at, accession)) AS accession, round(arg_max(value, (period_end, v.available_at, accession)), 4) + 0.0 AS value
FROM versions_l v JOIN cal ON v.available_at <= session GROUP BY 1, 2, 3""")
def join_04(spark, sf_dir):
    calendar = read(spark, sf_dir, "lineitem").select(F.last_day("l_shipdate").alias("session")).distinct()
    out = asof.pit_panel(panels.versions(spark, sf_dir), calendar, ["security_id", "field"])
    return out.select("security_id", "field", "session", "period_end", "accession", rounded(F.col("value"), 4).alias("value"))


@query("join_05_version_snapshot", f"""WITH {SQL_VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY security_id, field, year(period_end), quarter(period_end) ORDER BY period_end DESC, available_at DESC, accession DESC) AS k FROM versions_l WHERE available_at <= DATE '{CUT}')
SELECT security_id, field, year(period_end)::INT AS fy, quarter(period_end)::INT AS fq, period_end, accession, round(value, 4) + 0.0 AS value FROM r WHERE k = 1""")
def join_05(spark, sf_dir):
    v = panels.versions(spark, sf_dir).withColumns({"fy": F.year("period_end"), "fq": F.quarter("period_end")})
    out = asof.latest(v, ["security_id", "field", "fy", "fq"], ["period_end", "available_at", "accession"], F.col("available_at") <= _date(CUT), panels.tasks(read(spark, sf_dir, "lineitem")))
    return out.select("security_id", "field", "fy", "fq", "period_end", "accession", rounded(F.col("value"), 4).alias("value"))


_CATALOGUE = [("A", None, "F", "1990-01-01", "1997-12-31", 1, "returned"), ("A", None, "F", "1997-01-01", None, 2, "returned_late"), ("N", 7, "O", "1990-01-01", None, 1, "open_seven"), ("N", None, "O", "1990-01-01", None, 2, "open"), ("R", None, "F", "1996-01-01", None, 1, "refund"), ("R", None, "F", "1996-01-01", None, 1, "refund_twin")]


@query("join_06_effective_mapping", """WITH c(tag, issuer, unit, f, t, priority, field) AS (VALUES ('A', NULL, 'F', DATE '1990-01-01', DATE '1997-12-31', 1, 'returned'), ('A', NULL, 'F', DATE '1997-01-01', NULL, 2, 'returned_late'), ('N', 7, 'O', DATE '1990-01-01', NULL, 1, 'open_seven'), ('N', NULL, 'O', DATE '1990-01-01', NULL, 2, 'open'), ('R', NULL, 'F', DATE '1996-01-01', NULL, 1, 'refund'), ('R', NULL, 'F', DATE '1996-01-01', NULL, 1, 'refund_twin')),
f AS (SELECT l_returnflag AS tag, l_suppkey AS issuer, l_linestatus AS unit, CAST(l_shipdate AS DATE) AS filed, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
j AS (SELECT f.*, c.tag IS NOT NULL AS known, coalesce((c.issuer IS NULL OR c.issuer = f.issuer) AND filed >= c.f AND (c.t IS NULL OR filed <= c.t), false) AS r, coalesce(c.unit = f.unit, false) AS u, priority, c.field FROM f LEFT JOIN c ON c.tag = f.tag),
b AS (SELECT *, r AND u AND priority = min(CASE WHEN r AND u THEN priority END) OVER (PARTITION BY tag, issuer, unit, filed) AS best FROM j),
s AS (SELECT tag, issuer, unit, filed, count(*) FILTER (best) AS n, any_value(field) FILTER (best) AS field, bool_or(known) AS known, bool_or(r) AS r FROM b GROUP BY 1, 2, 3, 4)
SELECT tag, issuer, unit, filed, CASE WHEN n = 1 THEN field END AS field, CASE WHEN n = 1 THEN 'MAPPED' WHEN n > 1 THEN 'DEFERRED_SEMANTIC_AMBIGUITY' WHEN NOT known THEN 'DEFERRED_CUSTOM_TAG' WHEN r THEN 'DEFERRED_UNIT_OR_BASIS' ELSE 'DEFERRED_SEMANTIC' END AS status FROM s""")
def join_06(spark, sf_dir):
    c = spark.createDataFrame(_CATALOGUE, "tag string, issuer long, unit string, valid_from string, valid_to string, priority int, field string")
    c = c.withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tag"), F.col("l_suppkey").alias("issuer"), F.col("l_linestatus").alias("unit"), F.to_date("l_shipdate").alias("filed")).distinct()
    facts = facts.withColumn("fact_id", F.struct("tag", "issuer", "unit", "filed"))
    return asof.mapped(facts, c).select("fact_id.*", "field", "status")


@query("join_07_identity", """WITH i AS (SELECT n_nationkey, n_name, s_suppkey, s_acctbal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000)
SELECT n_nationkey, count(DISTINCT s_suppkey) AS n, CASE count(DISTINCT s_suppkey) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS issuer FROM i GROUP BY 1""")
def join_07(spark, sf_dir):
    """Names and places are looked up in an index; the number of issuers found decides the status."""
    wanted = read(spark, sf_dir, "nation").select("n_nationkey", F.upper(F.trim("n_name")).alias("name"))
    index = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(F.broadcast(wanted), F.col("s_nationkey") == F.col("n_nationkey")).select("name", F.col("s_suppkey").alias("issuer"))
    found = wanted.join(index, "name", "left").groupBy("n_nationkey").agg(F.count_distinct("issuer").alias("n"), F.min("issuer").alias("issuer"))
    status = F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return found.select("n_nationkey", "n", status.alias("status"), F.when(F.col("n") == 1, F.col("issuer")).alias("issuer"))


@query("join_08_overlap", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS m, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 10 AS e FROM orders)
SELECT a.k AS custkey, a.m AS orderkey, EXISTS (SELECT 1 FROM a b WHERE b.k = a.k AND b.m <> a.m AND a.s < b.e AND b.s < a.e) AS ambiguous FROM a""")
def join_08(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("start"))
    return asof.overlapping(o.withColumn("end", F.date_add("start", 10)), "custkey", "orderkey", "start", "end").select("custkey", "orderkey", "ambiguous")


@query("join_09_effective_lookup", f"""WITH {SQL_LABELS}, i AS (SELECT security_id, sector, effective_at AS f, lead(effective_at) OVER (PARTITION BY security_id ORDER BY effective_at) AS t FROM labels_l)
SELECT security_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(sector) END AS sector FROM i WHERE f <= DATE '{CUT}' AND (t IS NULL OR DATE '{CUT}' < t) GROUP BY 1""")
def join_09(spark, sf_dir):
    """The one row whose interval holds the cutoff; if there are more, none."""
    w = Window.partitionBy("security_id").orderBy("effective_at")
    i = panels.labels(spark, sf_dir).withColumn("until", F.lead("effective_at").over(w)).where((F.col("effective_at") <= _date(CUT)) & (F.col("until").isNull() | (F.col("until") > _date(CUT))))
    return i.groupBy("security_id").agg(F.count("*").alias("n"), F.min("sector").alias("s")).select("security_id", "n", F.when(F.col("n") == 1, F.col("s")).alias("sector"))


@query("join_10_order_fills", f"""WITH {SQL_SUPPLIERS}, o AS (SELECT s_suppkey AS security_id, DATE '1997-03-05' AS submitted, 1200.0 AS lim, 40 AS qty FROM supplier),
j AS (SELECT o.*, b.session, low, volume, row_number() OVER (PARTITION BY o.security_id ORDER BY b.session) AS k FROM o JOIN bars_l b ON b.security_id = o.security_id AND b.session >= submitted AND low < lim)
SELECT security_id, session, CAST(least(qty, floor(volume * 0.1)) AS BIGINT) AS filled FROM j WHERE k = 1""")
def join_10(spark, sf_dir):
    """The first bar after an order that trades below its limit; a share of the bar's volume fills."""
    o = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("order_id"), F.col("s_suppkey").alias("security_id"), F.lit("BUY").alias("side"), F.lit(40).alias("quantity"), F.lit(1200.0).alias("limit"), _date("1997-03-05").alias("submitted"))
    bars = panels.supplier_bars(spark, sf_dir).withColumn("end", F.date_add("session", 7))
    return first_touch(o, bars).where("session is not null").select("security_id", "session", "filled")


@query("join_11_next_trade", """WITH e AS (SELECT user_id, event_id, ts FROM events) SELECT a.event_id, (SELECT min(b.ts) FROM e b WHERE b.user_id = a.user_id AND b.ts > a.ts) AS next_ts FROM e a""")
def join_11(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return asof.next_at(e.select("user_id", "ts"), e.select("user_id", "event_id", F.col("ts").alias("asked")), ["user_id"], "ts", "asked").select("event_id", "next_ts")


@query("join_13_one_to_one", "SELECT s_suppkey, s_name, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def join_13(spark, sf_dir):
    """A join whose keys are unique on both sides."""
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return ac.one_to_one(s, n, "s_suppkey").select("s_suppkey", "s_name", "n")


@query("join_14_targets_positions", "WITH t AS (SELECT s_suppkey AS id, 0.5 AS w FROM supplier WHERE s_suppkey % 2 = 0), p AS (SELECT s_suppkey AS id, s_suppkey * 3 AS sh FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(t.id, p.id) AS security_id, CAST(coalesce(w, 0) AS DOUBLE) AS weight, coalesce(sh, 0) AS shares FROM t FULL JOIN p ON t.id = p.id")
def join_14(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    t, p = s.where("security_id % 2 = 0").withColumn("weight", F.lit(0.5)), s.where("security_id % 3 = 0").withColumn("shares", F.col("security_id") * 3)
    return t.join(p, "security_id", "full_outer").select("security_id", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("shares", F.lit(0)).cast("long").alias("shares"))


@query("join_15_unknown_ids", "SELECT c_custkey AS id, 'WITHOUT_ORDER' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT DISTINCT o_custkey, 'UNKNOWN' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def join_15(spark, sf_dir):
    """What only one of two id sets has."""
    c, o = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return c.join(o, "id", "left_anti").withColumn("side", F.lit("WITHOUT_ORDER")).unionByName(o.join(c, "id", "left_anti").withColumn("side", F.lit("UNKNOWN")))


@query("join_17_lineage", f"""WITH {SQL_VERSIONS}, p AS (SELECT security_id, field, accession, period_end, value + CASE WHEN accession % 50 = 0 THEN 1 ELSE 0 END AS value FROM versions_l WHERE accession % 7 <> 0)
SELECT field, count(*) AS n, count(*) FILTER (v.accession IS NULL) AS missing, count(*) FILTER (abs(p.value - v.value) > 1e-9 * greatest(1, abs(v.value))) AS differing FROM p LEFT JOIN (SELECT * FROM versions_l WHERE accession % 11 <> 0) v USING (security_id, field, accession, period_end) GROUP BY 1""")
def join_17(spark, sf_dir):
    """A panel against the versions it came from: lost sources and changed values."""
    v = panels.versions(spark, sf_dir)
    p = v.where("accession % 7 != 0").withColumn("value", F.col("value") + F.when(F.col("accession") % 50 == 0, 1).otherwise(0))
    keys = ["security_id", "field", "accession", "period_end"]
    out = ru.lineage(p, v.where("accession % 11 != 0"), keys)
    return out.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("lineage") == "MISSING").alias("missing"), F.count_if(F.col("lineage") == "DIFFERENT").alias("differing"))


@query("join_18_domicile", "SELECT s_suppkey, n_name, r_name IN ('AMERICA', 'EUROPE') AS domestic FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_18(spark, sf_dir):
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return out.select("s_suppkey", "n_name", F.col("r_name").isin("AMERICA", "EUROPE").alias("domestic"))


@query("join_19_next_session", "WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS s FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5), d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filed FROM orders), n AS (SELECT filed, (SELECT min(s) FROM cal WHERE s > filed) AS s FROM (SELECT DISTINCT filed FROM d)) SELECT o_orderkey, CASE WHEN s <= filed + 14 THEN s END AS next_session FROM d JOIN n USING (filed)")
def join_19(spark, sf_dir):
    """The first session after a filing, within two weeks."""
    cal = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct().where("dayofweek(session) between 2 and 6").withColumn("k", F.lit(1))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filed"))
    # each date is looked up once; dates are few
    found = asof.next_at(cal, o.select("filed").distinct().withColumn("k", F.lit(1)), ["k"], "session", "filed")
    out = o.join(F.broadcast(found.select("filed", "next_session")), "filed")
    return out.select("o_orderkey", F.when(F.col("next_session") <= F.date_add("filed", 14), F.col("next_session")).alias("next_session"))


# sets

add("set_01_bag_union", lambda spark, sf_dir: read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("c")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("s")), allowMissingColumns=True).groupBy("k").agg(F.sum("c").alias("customers"), F.sum("s").alias("suppliers")),
    "SELECT k, CAST(sum(c) AS BIGINT) AS customers, CAST(sum(s) AS BIGINT) AS suppliers FROM (SELECT c_nationkey AS k, 1 AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, 1 FROM supplier) GROUP BY 1")
add("set_02_intersection", lambda spark, sf_dir: read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session")).intersect(read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"))),
    "SELECT CAST(o_orderdate AS DATE) AS session FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
add("set_03_difference_status", lambda spark, sf_dir: ac.membership(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session")).distinct(), read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct(), "session"),
    "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS s FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS s FROM lineitem) SELECT coalesce(a.s, b.s) AS session, CASE WHEN a.s IS NULL THEN 'RIGHT_ONLY' WHEN b.s IS NULL THEN 'LEFT_ONLY' ELSE 'BOTH' END AS status FROM a FULL JOIN b ON a.s = b.s")
add("set_04_duplicates", lambda spark, sf_dir: dq.duplicate_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"),
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")


# sequences

@query("wn_03_row_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS place, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST) AS national FROM supplier")
def wn_03(spark, sf_dir):
    """Places of all rows by cells of values, and ranks within a group."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    national = F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("s_acctbal"))).cast("long")
    return places(s, "s_acctbal", "s_suppkey").select("s_suppkey", "place", national.alias("national"))


@query("wn_04_12_representative", "WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 13 = 0 DESC, s_acctbal DESC NULLS LAST, s_suppkey) AS k FROM supplier) SELECT s_nationkey, s_suppkey FROM r WHERE k = 1")
def wn_12(spark, sf_dir):
    """One security for each issuer: the incumbent, else the most traded."""
    s = read(spark, sf_dir, "supplier").withColumn("incumbent", (F.col("s_suppkey") % 13 == 0).cast("int"))
    return asof.latest(s, ["s_nationkey"], [F.col("incumbent"), F.col("s_acctbal"), -F.col("s_suppkey")]).select("s_nationkey", "s_suppkey")


@query("wn_05_adv_history", f"""WITH {SQL_SUPPLIERS}, b AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session DESC) AS k, count(*) OVER (PARTITION BY security_id) AS n FROM bars_l)
SELECT security_id, any_value(n) AS history, round(CASE WHEN any_value(n) >= 20 THEN avg(close * volume) END, 4) + 0.0 AS adv, max(close) FILTER (k = 1) AS last_close FROM b WHERE k <= 20 GROUP BY 1""")
def wn_05(spark, sf_dir):
    w = Window.partitionBy("security_id").orderBy(F.desc("session"))
    b = panels.supplier_bars(spark, sf_dir).withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("security_id"))}).where("k <= 20")
    return b.groupBy("security_id").agg(F.max("n").alias("history"), rounded(F.when(F.max("n") >= 20, F.avg(F.col("close") * F.col("volume"))), 4).alias("adv"), F.max(F.when(F.col("k") == 1, F.col("close"))).alias("last_close"))


@query("wn_13_previous_signal", "WITH d AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders), k AS (SELECT *, dense_rank() OVER (ORDER BY m) AS o FROM d) SELECT a.o_custkey, CAST(a.o AS BIGINT) AS ordinal, b.o IS NOT NULL AS also_before FROM k a LEFT JOIN k b ON b.o_custkey = a.o_custkey AND b.o = a.o - 1")
def wn_13(spark, sf_dir):
    """Signals are numbered on the small table of their dates, then joined on the number before."""
    d = read(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    months = d.select("m").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("m")).cast("long"))
    k = d.join(F.broadcast(months), "m").select("o_custkey", "ordinal")
    then = k.select("o_custkey", (F.col("ordinal") + 1).alias("ordinal"), F.lit(True).alias("also_before"))
    return k.join(then, ["o_custkey", "ordinal"], "left").withColumn("also_before", F.coalesce("also_before", F.lit(False)))


# accounts and actions

@query("ca_01_visible_actions", f"WITH {SQL_LABELS} SELECT security_id, sector AS kind, effective_at FROM labels_l WHERE available_at <= DATE '{CUT}'")
def ca_01(spark, sf_dir):
    actions = panels.labels(spark, sf_dir).select("security_id", F.col("sector").alias("kind"), "effective_at", "available_at")
    return ac.visible_actions(actions, _date(CUT)).select("security_id", "kind", "effective_at")


_SQL_SPLITS = "sp AS (SELECT s_suppkey AS security_id, DATE '1997-06-01' AS effective_at, 2.0::DOUBLE AS ratio FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, DATE '1999-06-01', 1.5 FROM supplier WHERE s_suppkey % 4 = 0)"


def _splits(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    return s.where("security_id % 2 = 0").select("security_id", _date("1997-06-01").alias("effective_at"), F.lit(2.0).alias("ratio")).unionByName(s.where("security_id % 4 = 0").select("security_id", _date("1999-06-01").alias("effective_at"), F.lit(1.5).alias("ratio")))


@query("ca_02_split_shares", f"""WITH {_SQL_SPLITS}, p AS (SELECT s_suppkey AS security_id, s_suppkey * 3 AS shares, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1998-01-01' ELSE DATE '1997-01-01' END AS held_from FROM supplier),
f AS (SELECT p.security_id, product(ratio) AS r FROM p JOIN sp ON sp.security_id = p.security_id AND effective_at > held_from GROUP BY 1)
SELECT p.security_id, round(shares * coalesce(r, 1), 6) + 0.0 AS shares, shares * coalesce(r, 1) = floor(shares * coalesce(r, 1)) AS whole FROM p LEFT JOIN f USING (security_id)""")
def ca_02(spark, sf_dir):
    """Holdings after the splits that came later than they did."""
    s = F.col("s_suppkey")
    held = read(spark, sf_dir, "supplier").select(s.alias("security_id"), (s * 3).alias("shares"), F.when(s % 3 == 0, _date("1998-01-01")).otherwise(_date("1997-01-01")).alias("at"))
    return ac.split_shares(held, _splits(spark, sf_dir)).select("security_id", rounded(F.col("shares")).alias("shares"), "whole")


@query("ca_03_05_dividends_equity", """WITH d AS (SELECT s_suppkey AS security_id, s_suppkey * 2 AS shares, 10.0 + s_suppkey AS mark, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1998-06-01' ELSE DATE '1998-05-29' END AS since, 0.25 * (s_suppkey % 5) AS amount, DATE '1998-06-01' AS ex, DATE '1998-07-15' AS pay FROM supplier),
t AS (SELECT CAST(coalesce(sum(shares * amount) FILTER (since < ex AND ex <= DATE '1998-06-30' AND DATE '1998-06-30' < pay), 0) AS DOUBLE) AS receivable, CAST(sum(shares * CASE WHEN security_id % 10 = 0 THEN 0 ELSE mark END) AS DOUBLE) AS positions FROM d)
SELECT receivable, positions, 1000 + positions + receivable AS equity FROM t""")
def ca_03(spark, sf_dir):
    """Who held before the ex date has a receivable until it is paid; delisted shares count at their terminal value."""
    s = F.col("s_suppkey")
    held = read(spark, sf_dir, "supplier").select(s.alias("security_id"), (s * 2).alias("shares"), (s + 10.0).alias("mark"), F.when(s % 3 == 0, _date("1998-06-01")).otherwise(_date("1998-05-29")).alias("since"))
    dividends = held.select("security_id", (0.25 * (F.col("security_id") % 5)).alias("amount"), _date("1998-06-01").alias("ex_date"), _date("1998-07-15").alias("pay_date"))
    terminal = held.where("security_id % 10 = 0").select("security_id", F.lit(0.0).alias("terminal_value"))
    return ac.equity(held, dividends, terminal, F.lit(1000.0), _date(CUT))


@query("ca_06_fills", "WITH f AS (SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders) SELECT o_custkey AS account, count(*) AS n_fills, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS BIGINT) AS position, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) + 0.0 AS cash FROM f GROUP BY 1")
def ca_06(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    fills = o.unionByName(o.where("o_orderkey % 5 = 0")).select(F.col("o_orderkey").alias("fill_id"), F.col("o_custkey").alias("account"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("quantity"), F.col("o_totalprice").alias("price"))
    return ac.imported_fills(fills).withColumn("cash", rounded(F.col("cash"), 2))


@query("ca_07_quotes", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT (0 < bid AND bid <= ask) THEN 'CROSSED' END, CASE WHEN age > 60 THEN 'STALE' END, CASE WHEN halted THEN 'HALTED' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT o_orderkey, o_totalprice AS bid, o_totalprice + (o_orderkey % 5) - 1 AS ask, o_orderkey % 100 AS age, o_orderkey % 17 = 0 AS halted FROM orders)""")
def ca_07(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("bid"), (F.col("o_totalprice") + F.col("o_orderkey") % 5 - 1).alias("ask"), (F.col("o_orderkey") % 100).alias("age"), (F.col("o_orderkey") % 17 == 0).alias("halted"))
    return o.select("o_orderkey", F.array_join(sc.reasons({"CROSSED": ~((F.col("bid") > 0) & (F.col("bid") <= F.col("ask"))), "STALE": F.col("age") > 60, "HALTED": F.col("halted")}), ",").alias("reasons"))


@query("ca_08_09_exposure_windows", """WITH e AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 5 AS t, [o_orderpriority] AS scope FROM orders)
SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.c = b.c AND a.id < b.id AND a.s < b.t AND b.s < a.t AND list_has_any(a.scope, b.scope)""")
def ca_09(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 5).alias("t"), F.array("o_orderpriority").alias("scope"))
    return ac.exposures(o, "c").select("a", "b")


@query("tk_13_whole_shares", """WITH t AS (SELECT s_suppkey AS id, 0.01 AS w FROM supplier WHERE s_suppkey % 2 = 0), p AS (SELECT s_suppkey AS id, s_suppkey AS sh FROM supplier WHERE s_suppkey % 3 = 0),
j AS (SELECT coalesce(t.id, p.id) AS id, coalesce(w, 0) AS w, coalesce(sh, 0) AS held, CAST(10 + coalesce(t.id, p.id) AS DECIMAL(20,6)) AS price FROM t FULL JOIN p ON t.id = p.id), k AS (SELECT *, CAST(floor(CAST(w AS DECIMAL(20,6)) * 100000 / price) AS BIGINT) AS target FROM j)
SELECT id AS security_id, held, target, target - held AS difference, CASE WHEN target > held THEN 'BUY' WHEN target < held THEN 'SELL' ELSE 'KEEP' END AS side, round(abs(target - held) * CAST(price AS DOUBLE), 4) + 0.0 AS notional FROM k""")
def tk_13(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    out = whole_shares(s.where("security_id % 2 = 0").withColumn("target_weight", F.lit(0.01)), s.where("security_id % 3 = 0").withColumn("shares", F.col("security_id")), s.withColumn("price", F.col("security_id") + 10), F.lit(100000))
    return out.select("security_id", "held", "target", "difference", "side", rounded(F.col("notional"), 4).alias("notional"))


# roll-ups

@query("ag_16_field_coverage", f"WITH {SQL_VERSIONS} SELECT field, count(*) AS n_rows, count(DISTINCT security_id) AS securities, count(DISTINCT available_at) AS sessions, round(avg(CASE WHEN isfinite(value) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS finite FROM versions_l GROUP BY 1")
def ag_16(spark, sf_dir):
    return ru.field_coverage(panels.versions(spark, sf_dir)).withColumn("finite", rounded(F.col("finite")))


@query("ag_18_coverage_counts", "SELECT count(*) AS requested, count(*) FILTER (c_acctbal >= 0) AS eligible, count(*) FILTER (c_acctbal < 0) AS excluded, count(*) FILTER (c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS processed FROM customer")
def ag_18(spark, sf_dir):
    done = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return ru.coverage_counts(read(spark, sf_dir, "customer"), done, "c_custkey", F.col("c_acctbal") >= 0)


@query("ag_22_calendar_returns", f"""WITH {SQL_SUPPLIERS}, m AS (SELECT session, avg(close) AS v FROM bars_l GROUP BY 1), y AS (SELECT year(session)::INT AS year, last(v ORDER BY session) AS v, first(v ORDER BY session) AS f FROM m GROUP BY 1) SELECT year, round(v / coalesce(lag(v) OVER (ORDER BY year), f) - 1, 6) + 0.0 AS change FROM y""")
def ag_22(spark, sf_dir):
    m = panels.supplier_bars(spark, sf_dir).groupBy("session").agg(F.avg("close").alias("v"))
    return ru.calendar_returns(m, "v").withColumn("change", rounded(F.col("change")))


@query("ag_24_trade_totals", """WITH t AS (SELECT l_linestatus, l_extendedprice AS x, l_extendedprice * l_tax AS fee, l_returnflag FROM lineitem)
SELECT l_linestatus, round(sum(x), 2) + 0.0 AS notional, round(sum(x) / 1e6, 6) + 0.0 AS gross_turnover, round(sum(x) / 2e6, 6) + 0.0 AS half_turnover, round(sum(fee), 2) + 0.0 AS fees, round(sum(CASE WHEN l_returnflag = 'R' THEN x ELSE -x END - fee), 2) + 0.0 AS cash_change FROM t GROUP BY 1""")
def ag_24(spark, sf_dir):
    x = F.col("l_extendedprice")
    t = read(spark, sf_dir, "lineitem").select("l_linestatus", x.alias("notional"), (x * F.col("l_tax")).alias("fee"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.lit(1e6).alias("nav"))
    digits = {"notional": 2, "gross_turnover": 6, "half_turnover": 6, "fees": 2, "cash_change": 2}
    return ru.trade_totals(t, "l_linestatus").select("l_linestatus", *(rounded(F.col(c), d).alias(c) for c, d in digits.items()))


@query("ag_27_time_weighted", """WITH s AS (SELECT o_custkey AS account, o_orderkey AS k, o_orderdate AS t, 1000 + o_totalprice / 1000 AS pre, CASE WHEN o_orderkey % 4 = 0 THEN 50.0 ELSE 0.0 END AS flow FROM orders), r AS (SELECT account, coalesce((pre - flow) / lag(pre) OVER (PARTITION BY account ORDER BY t, k), 1) * ((pre - 1) / pre) AS f FROM s) SELECT account, round(product(f) - 1, 6) + 0.0 AS total FROM r GROUP BY 1""")
def ag_27(spark, sf_dir):
    """Accounts whose trades cost one at each snapshot."""
    s = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.struct("o_orderdate", "o_orderkey").alias("at"), (1000 + F.col("o_totalprice") / 1000).alias("pre"), F.when(F.col("o_orderkey") % 4 == 0, 50.0).otherwise(0.0).alias("flow"))
    return ru.time_weighted(s.withColumn("post", F.col("pre") - 1)).withColumn("total", rounded(F.col("total")))


@query("ag_28_registry_rollup", "WITH d AS (SELECT p_brand AS id, p_type || '|' || p_size AS h, p_size FROM part) SELECT id, count(*) AS n, count(DISTINCT h) AS definitions, count(DISTINCT h) > 1 AS conflicting, count(*) FILTER (p_size > 10) AS safe, count(*) FILTER (p_size % 2 = 0) AS complete FROM d GROUP BY 1")
def ag_28(spark, sf_dir):
    d = read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), sc.identity(F.col("p_type"), F.col("p_size")).alias("hash"), (F.col("p_size") > 10).alias("safe"), (F.col("p_size") % 2 == 0).alias("complete"))
    return ru.registry_rollup(d)


@query("ag_29_31_field_demand", """WITH f AS (SELECT DISTINCT p_partkey AS definition_id, unnest(string_split(p_type, ' ')) AS field FROM part), w AS (SELECT field, length(field) AS n FROM (SELECT DISTINCT field FROM f)), s AS (SELECT 'wide' AS provider, field FROM w UNION ALL SELECT 'narrow', field FROM w WHERE n > 5)
SELECT definition_id, provider, count(*) AS needed, count(s.field) AS supported, count(*) = count(s.field) AS candidate FROM f CROSS JOIN (SELECT DISTINCT provider FROM s) p LEFT JOIN s USING (provider, field) GROUP BY 1, 2""")
def ag_29(spark, sf_dir):
    """Which parts each of two providers can serve, one of all words and one of long words."""
    f = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("definition_id"), F.explode(F.split("p_type", " ")).alias("field"))
    words = f.select("field").distinct()
    supported = words.withColumn("provider", F.lit("wide")).unionByName(words.where("length(field) > 5").withColumn("provider", F.lit("narrow")))
    return ru.field_demand(f, supported)


@query("ag_30_reason_histogram", "WITH r AS (SELECT unnest(list_filter([CASE WHEN s_acctbal < 0 THEN 'BALANCE:' || s_nationkey END, CASE WHEN s_suppkey % 3 = 0 THEN 'THIRD:x' END], lambda x: x IS NOT NULL)) AS r FROM supplier) SELECT split_part(r, ':', 1) AS reason, count(*) AS n FROM r GROUP BY 1")
def ag_30(spark, sf_dir):
    r = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, F.concat(F.lit("BALANCE:"), F.col("s_nationkey"))), F.when(F.col("s_suppkey") % 3 == 0, F.lit("THIRD:x"))))
    return ru.reason_histogram(read(spark, sf_dir, "supplier").withColumn("reasons", r))


@query("ag_32_identity_dedupe", "WITH p AS (SELECT p_partkey AS definition_id, first_value(p_partkey) OVER w AS kept_id, row_number() OVER w AS k FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey)) SELECT definition_id, kept_id, CASE WHEN k = 1 THEN 'KEPT' ELSE 'SAME_IDENTITY' END AS reason FROM p")
def ag_32(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("definition_id"), "p_brand", "p_size", "p_retailprice")
    return deduplicated(p, ["p_brand", "p_size"], [F.desc("p_retailprice"), F.asc("definition_id")]).select("definition_id", "kept_id", "reason")


# quality

@query("dq_01_uniqueness", "SELECT 'DUPLICATE_LINE' AS check, CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dq_01(spark, sf_dir):
    return dq.unique_check(read(spark, sf_dir, "lineitem"), "DUPLICATE_LINE", "l_orderkey", "l_linenumber")


@query("dq_02_provenance", "SELECT 'MIXED_PROVENANCE' AS check, count(*) FILTER (a > 1 OR b > 1) AS failed_rows FROM (SELECT count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY o_custkey)")
def dq_02(spark, sf_dir):
    return dq.one_value_check(read(spark, sf_dir, "orders"), "MIXED_PROVENANCE", ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("dq_03_grid_alignment", f"WITH {SQL_EVENTS} SELECT 'DENSE' AS check, 0::BIGINT AS failed_rows UNION ALL SELECT 'SPARSE', count(*) FILTER (n <> (SELECT count(DISTINCT session) FROM bars_e)) FROM (SELECT count(*) AS n FROM bars_e GROUP BY security_id)")
def dq_03(spark, sf_dir):
    """Every security has every session once: in the dense grid all have, among the bars it is made of not all."""
    return dq.alignment_check(panels.event_grid(spark, sf_dir), "DENSE").unionByName(dq.alignment_check(panels.event_bars(spark, sf_dir), "SPARSE"))


@query("dq_04_05_causality", f"""WITH {SQL_VERSIONS}, v AS (SELECT available_at, period_end, CASE WHEN accession % 97 = 0 THEN NULL WHEN accession % 83 = 0 THEN -value ELSE value END AS value, CASE WHEN accession % 89 = 0 THEN ' ' ELSE field END AS field FROM versions_l)
SELECT 'LOOK_AHEAD' AS check, count(*) FILTER (available_at < period_end) AS failed_rows FROM v UNION ALL SELECT 'NOT_FINITE', count(*) FILTER (value IS NULL OR NOT isfinite(value)) FROM v
UNION ALL SELECT 'BLANK_FIELD', count(*) FILTER (trim(field) = '') FROM v UNION ALL SELECT 'NEGATIVE', count(*) FILTER (value IS NULL OR value < 0) FROM v""")
def dq_04(spark, sf_dir):
    """Versions with planted faults; a fact known before its period ends is a look ahead."""
    a = F.col("accession")
    v = panels.versions(spark, sf_dir).withColumns({"value": F.when(a % 97 == 0, None).when(a % 83 == 0, -F.col("value")).otherwise(F.col("value")), "field": F.when(a % 89 == 0, " ").otherwise(F.col("field"))})
    rules = {"LOOK_AHEAD": F.col("available_at") >= F.col("period_end"), "NOT_FINITE": sc.is_finite(F.col("value")), "BLANK_FIELD": F.trim("field") != "", "NEGATIVE": F.col("value") >= 0}
    return dq.count_checks(v, rules)


@query("dq_06_reconciliation", f"""WITH {SQL_VERSIONS}, e AS (SELECT s_suppkey AS security_id, f.field, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = f.field)::DOUBLE AS expected FROM supplier, (SELECT DISTINCT l_returnflag AS field FROM lineitem) f),
v AS (SELECT security_id, field, count(*)::DOUBLE AS value FROM versions_l WHERE value > 3000 GROUP BY 1, 2)
SELECT e.security_id, e.field, CASE WHEN v.value IS NULL THEN 'MISSING' WHEN abs(v.value - coalesce(expected, 0)) <= 1e-6 THEN 'MATCH' ELSE 'DIFFERENT' END AS status FROM e LEFT JOIN v USING (security_id, field)""")
def dq_06(spark, sf_dir):
    """Orders of each supplier and flag, counted off the line items, against versions of some size."""
    li = read(spark, sf_dir, "lineitem")
    counted = li.repartition(panels.tasks(li), "l_orderkey").groupBy(F.col("l_suppkey").alias("security_id"), F.col("l_returnflag").alias("field")).agg(F.count_distinct("l_orderkey").cast("double").alias("expected"))
    every = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id")).join(F.broadcast(li.select(F.col("l_returnflag").alias("field")).distinct()))
    e = every.join(counted, ["security_id", "field"], "left").fillna(0.0, ["expected"])
    v = panels.versions(spark, sf_dir).where("value > 3000").groupBy("security_id", "field").agg(F.count("*").cast("double").alias("value"))
    return dq.reconciled(e, v, ["security_id", "field"]).select("security_id", "field", "status")


@query("dq_08_secret_scan", """SELECT 'text' AS check, count(*) FILTER (regexp_matches(text, '(?i)(?:api[_-]?key|secret|password|passwd|authorization|bearer|token)\\s*[:=]\\s*["'']?[^\\s,"'']{8,}')) AS failed_rows FROM documents""")
def dq_08(spark, sf_dir):
    return dq.secret_like(read(spark, sf_dir, "documents").select("text"))


@query("dq_11_fingerprint", """SELECT count(*) AS n_rows, sum(CAST('0x' || substr(md5(concat_ws(chr(31), coalesce(l_linenumber::VARCHAR, chr(30)), coalesce(l_orderkey::VARCHAR, chr(30)), coalesce(l_partkey::VARCHAR, chr(30)), coalesce(l_returnflag, chr(30)), coalesce(CAST(l_shipdate AS DATE)::VARCHAR, chr(30)), coalesce(l_suppkey::VARCHAR, chr(30)))), 1, 15) AS BIGINT))::VARCHAR AS fingerprint FROM lineitem""")
def dq_11(spark, sf_dir):
    return dq.fingerprint(read(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_returnflag", F.to_date("l_shipdate").alias("l_shipdate"), "l_suppkey"))


@query("dq_12_replay_comparison", "SELECT o_orderkey, 'LEFT' AS side FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey + 100000000, 'RIGHT' FROM orders WHERE o_orderkey % 10 = 0")
def dq_12(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    moved = o.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") + 100000000).otherwise(F.col("o_orderkey"))).withColumn("o_orderstatus", F.lit("?"))
    return dq.differences(o, moved, ("o_orderstatus",)).select("o_orderkey", "side")


@query("dq_13_17_gates", "SELECT s_nationkey, count(*) AS n, CASE WHEN count(*) < 3 THEN 'BLOCKED' ELSE 'PASS' END AS size_gate, bool_and(s_acctbal >= -900) AS sane FROM supplier GROUP BY 1")
def dq_13(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.when(F.count("*") < 3, "BLOCKED").otherwise("PASS").alias("size_gate"), F.bool_and(F.col("s_acctbal") >= -900).alias("sane"))
