"""Sources, fundamentals and the remaining roll-ups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.operators import diagnostics as dg
from tidepanel.operators import quality as dq
from tidepanel.operators.fundamentals import derived, periods
from tidepanel.plans.factor_queries import SQL_BASE, SQL_TOP, pairs, scores
from tidepanel.plans.registry import query, rounded
from tidepanel.sources import filings, panels
from tidepanel.sources import panel_store as store
from tidepanel.sources.panels import SQL_EVENTS, SQL_VERSIONS, read
from tidepanel.sources.shared import scratch


def ledger_facts(spark, sf_dir) -> DataFrame:
    """Cumulative facts per supplier and year of shipping: Q1, H1, 9M and FY, and for every third supplier a restated FY."""
    li = read(spark, sf_dir, "lineitem")
    sums = li.groupBy(F.col("l_suppkey").alias("security_id"), F.year("l_shipdate").alias("fiscal_year")).agg(*(F.sum(F.when(F.quarter("l_shipdate") <= q, F.round("l_extendedprice")).otherwise(0.0)).alias(f"c{q}") for q in range(1, 5)))
    ends = ("03-31", "06-30", "09-30", "12-31")
    facts = F.array(*(F.struct(F.lit("FY" if q == 4 else f"Q{q}").alias("fiscal_period"), F.to_date(F.concat(F.col("fiscal_year"), F.lit(f"-{ends[q - 1]}"))).alias("period_end"), F.col(f"c{q}").alias("value"), F.lit(0).alias("again")) for q in range(1, 5)))
    restated = F.struct(F.lit("FY").alias("fiscal_period"), F.to_date(F.concat(F.col("fiscal_year"), F.lit("-12-31"))).alias("period_end"), (F.col("c4") + 10).alias("value"), F.lit(1).alias("again"))
    rows = sums.select("security_id", "fiscal_year", F.explode(F.when(F.col("security_id") % 3 == 0, F.array_append(facts, restated)).otherwise(facts)).alias("f")).select("security_id", "fiscal_year", "f.*")
    return rows.select("security_id", F.lit("revenue").alias("field"), F.lit("usd").alias("unit"), "fiscal_year", "fiscal_period", F.to_date(F.concat(F.col("fiscal_year"), F.lit("-01-01"))).alias("period_start"), "period_end",
        F.date_add("period_end", F.when(F.col("again") == 1, 100).otherwise(40)).alias("available_at"), F.concat_ws("-", "fiscal_year", "fiscal_period", "again").alias("accession"), F.concat_ws("-", "security_id", "fiscal_year", "fiscal_period", "again").alias("source_id"), "value")


_SQL_QUARTERS = """c AS (SELECT l_suppkey AS security_id, year(l_shipdate)::INT AS fy, quarter(l_shipdate) AS q, sum(round(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2, 3),
y AS (SELECT DISTINCT security_id, fy FROM c), f AS (SELECT security_id, fy, q.q, coalesce(v, 0) AS v, last_day(make_date(fy, (q.q * 3)::INT, 1)) AS period_end FROM y CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q) q LEFT JOIN c USING (security_id, fy, q)),
q AS (SELECT security_id, fy, 'Q' || q AS quarter, period_end, period_end + 40 AS available_at, v AS value FROM f UNION ALL SELECT security_id, fy, 'Q4', period_end, period_end + 100, v + 10 FROM f WHERE q = 4 AND security_id % 3 = 0)"""


@query("wn_06_quarters", f"WITH {_SQL_QUARTERS} SELECT security_id, fy AS fiscal_year, quarter, period_end, CAST(available_at AS DATE) AS available_at, value FROM q")
def wn_06(spark, sf_dir):
    return periods.quarters(ledger_facts(spark, sf_dir)).select("security_id", "fiscal_year", "quarter", "period_end", "available_at", "value")


@query("wn_07_trailing_year", f"""WITH {_SQL_QUARTERS}, k AS (SELECT e.security_id, e.available_at, v.period_end, arg_max(v.value, v.available_at) AS value FROM q e JOIN q v ON v.security_id = e.security_id AND v.available_at <= e.available_at GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY security_id, available_at ORDER BY period_end DESC) AS p FROM k), z AS (SELECT * FROM r WHERE p <= 4),
g AS (SELECT *, date_diff('day', lag(period_end) OVER (PARTITION BY security_id, available_at ORDER BY period_end), period_end) AS gap FROM z)
SELECT security_id, CAST(available_at AS DATE) AS available_at, max(period_end) AS period_end, sum(value) AS value FROM g GROUP BY 1, 2 HAVING count(*) = 4 AND min(coalesce(gap, 90)) >= 70 AND max(coalesce(gap, 90)) <= 120""")
def wn_07(spark, sf_dir):
    return periods.trailing_year(periods.quarters(ledger_facts(spark, sf_dir))).select("security_id", "available_at", "period_end", "value")


@query("wn_08_annual_proxy", f"WITH {_SQL_QUARTERS} SELECT security_id, fy AS fiscal_year, count(*) AS n FROM q WHERE quarter = 'Q4' AND fy % 3 = 0 GROUP BY 1, 2")
def wn_08(spark, sf_dir):
    """Annual facts stand in where quarters are missing: here those of every third year."""
    facts = ledger_facts(spark, sf_dir)
    known = facts.where("fiscal_period = 'FY' or fiscal_year % 3 != 0")
    return periods.annual_proxy(known, periods.trailing_year(periods.quarters(known))).groupBy("security_id", "fiscal_year").agg(F.count("*").alias("n"))


@query("wn_09_10_bases", f"WITH {_SQL_QUARTERS} SELECT 'RAW' AS basis, count(*) AS n FROM q UNION ALL SELECT 'ANNUAL', count(*) FROM q WHERE quarter = 'Q4' UNION ALL SELECT 'QUARTERLY_DISCRETE', count(*) FROM q")
def wn_10(spark, sf_dir):
    return periods.by_basis(ledger_facts(spark, sf_dir)).where("basis != 'TTM'").groupBy("basis").agg(F.count("*").alias("n"))


@query("wn_11_yearly_growth", """WITH c AS (SELECT l_suppkey AS security_id, year(l_shipdate)::INT AS fiscal_year, sum(round(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.security_id, a.fiscal_year, CASE WHEN b.v IS NULL THEN 'PRIOR_FISCAL_YEAR_MISSING' WHEN b.v <= 0 THEN 'NON_POSITIVE_DENOMINATOR' END AS reason, round(CASE WHEN b.v > 0 THEN a.v / b.v - 1 END, 6) + 0.0 AS growth FROM c a LEFT JOIN c b ON b.security_id = a.security_id AND b.fiscal_year = a.fiscal_year - 1""")
def wn_11(spark, sf_dir):
    annual = ledger_facts(spark, sf_dir).where("fiscal_period = 'FY' and accession like '%-0'")
    return derived.yearly_growth(annual).select("security_id", "fiscal_year", "reason", rounded(F.col("growth")).alias("growth"))


@query("fd_01_02_availability", "SELECT o_orderkey, greatest(o_orderdate + INTERVAL 10 MINUTE, o_orderdate + to_days((o_orderkey % 3)::INT)) AS available_at FROM orders")
def fd_01(spark, sf_dir):
    """The later of acceptance plus ten minutes and first sight."""
    o = read(spark, sf_dir, "orders")
    seen = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 3).cast("int"))
    return o.select("o_orderkey", F.greatest(F.col("o_orderdate") + F.expr("interval 10 minutes"), seen).alias("available_at"))


@query("fd_04_catalogue_overlap", "WITH c AS (SELECT o_custkey AS tag, o_orderkey AS id, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 30 AS t FROM orders), l AS (SELECT *, lag(t) OVER (PARTITION BY tag ORDER BY f, id) AS p FROM c) SELECT tag, count(*) AS n FROM l WHERE p >= f GROUP BY 1")
def fd_04(spark, sf_dir):
    """Ranges of equal priority that overlap the one before."""
    c = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tag"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("f"), F.date_add(F.to_date("o_orderdate"), 30).alias("t"))
    return c.withColumn("p", F.lag("t").over(Window.partitionBy("tag").orderBy("f", "id"))).where("p >= f").groupBy("tag").agg(F.count("*").alias("n"))


@query("fd_05_reviewed_facts", "SELECT field, count(*) AS n FROM (SELECT l_returnflag AS field, l_suppkey FROM lineitem) WHERE field <> 'A' OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def fd_05(spark, sf_dir):
    """Facts of one field stay only if they are on the reviewed list."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("field"), "l_suppkey")
    listed = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    kept = li.where("field = 'A'").join(listed, "l_suppkey", "left_semi").select("field").unionByName(li.where("field != 'A'").select("field"))
    return kept.groupBy("field").agg(F.count("*").alias("n"))


@query("fd_09_10_signs_and_identity", "SELECT l_suppkey % 7 AS k, count(*) AS n, round(sum(abs(v)), 2) + 0.0 AS total FROM (SELECT DISTINCT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS v FROM lineitem) GROUP BY 1")
def fd_09(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("field"), F.lit(1).alias("session"), F.when(F.col("l_suppkey") % 2 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("v"))
    once = derived.once_per_inputs(li, ["l_suppkey", "v"])
    return once.groupBy((F.col("l_suppkey") % 7).alias("k")).agg(F.count("*").alias("n"), rounded(F.sum(derived.normalised_sign(F.col("v"), F.lit("POSITIVE_EXPENSE"))), 2).alias("total"))


@query("fd_12_panel_read", f"""WITH {SQL_VERSIONS}, v AS (SELECT security_id, available_at, arg_max(value, (period_end, accession)) AS value FROM versions_l WHERE field = 'R' AND available_at BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' GROUP BY 1, 2)
SELECT g.session, g.security_id, round(v.value, 4) + 0.0 AS value FROM (SELECT DISTINCT available_at AS session FROM v) d CROSS JOIN (SELECT DISTINCT security_id FROM v) i JOIN LATERAL (SELECT d.session, i.security_id) g ON true LEFT JOIN v ON v.security_id = g.security_id AND v.available_at = g.session""")
def fd_12(spark, sf_dir):
    """One field of a window of dates on the dense grid."""
    v = panels.versions(spark, sf_dir).where("field = 'R' and available_at between date'1997-01-01' and date'1997-03-31'")
    one = v.groupBy("security_id", F.col("available_at").alias("session")).agg(F.max_by("value", F.struct("period_end", "accession")).alias("value"))
    return panels.densify(one).select("session", "security_id", rounded(F.col("value"), 4).alias("value"))


@query("src_01_wide_panel", f"WITH {SQL_EVENTS} SELECT session, CAST(security_id AS VARCHAR) AS security_id, close FROM grid_e WHERE close IS NOT NULL")
def src_01(spark, sf_dir):
    """A wide field panel of all securities, in files of bounded width, read back to rows."""
    path = scratch(spark, "wide-panel")
    store.write_wide(panels.event_bars(spark, sf_dir).select("session", "security_id", "close"), path, ["close"])
    return store.read_wide(spark, path, required=("close",)).select("session", "security_id", "close")


@query("src_03_04_pruned_window", "SELECT l_suppkey, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1")
def src_03(spark, sf_dir):
    """Two columns and a range of dates, both pushed into the scan."""
    li = read(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1997-01-01' and l_shipdate < timestamp'1997-04-01'")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))


@query("src_06_repair_overlay", """WITH r AS (SELECT o_custkey AS k, 0 AS r, o_totalprice AS v, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice + 1 END, o_orderkey FROM orders WHERE o_orderkey % 4 = 0),
d AS (SELECT o_orderkey, arg_max(v, r) FILTER (v IS NOT NULL) AS v FROM (SELECT o_orderkey, r, max(v) AS v FROM r GROUP BY 1, 2) GROUP BY 1) SELECT o_orderkey, v FROM d""")
def src_06(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    base = o.where("o_orderkey % 2 = 0").withColumn("round", F.lit(0))
    repair = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("v") + 1).alias("v"), F.lit(1).alias("round"))
    rows = base.unionByName(repair).groupBy("o_orderkey", "round").agg(F.max("v").alias("v"))
    return filings.overlaid(rows, ["o_orderkey"], ["v"])


@query("src_07_nested_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_07(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("src_10_latest_artifacts", """WITH l AS (SELECT o_custkey AS issuer, o_orderstatus AS kind, o_orderpriority AS url, o_orderdate AS requested_at, o_orderkey AS sha, o_orderdate + to_days((o_orderkey % 5)::INT) AS first_seen_at FROM orders WHERE o_orderdate + to_days((o_orderkey % 5)::INT) <= TIMESTAMP '1998-01-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY issuer, kind, url ORDER BY requested_at DESC, sha DESC) AS k FROM l) SELECT issuer, kind, url, sha FROM r WHERE k = 1""")
def src_10(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("url"), F.col("o_orderdate").alias("requested_at"), F.col("o_orderkey").alias("sha"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 5).cast("int"))).alias("first_seen_at"))
    return filings.latest_artifacts(o, F.lit("1998-01-01").cast("timestamp")).select("issuer", "kind", "url", "sha")


@query("ag_10_pooled_conflicts", f"""{SQL_BASE}, {SQL_TOP}, a AS (SELECT factor_id, session, security_id, score FROM s WHERE score IS NOT NULL),
j AS (SELECT a.factor_id AS factor_a, b.factor_id AS factor_b, a.score AS x, b.score AS y FROM a JOIN a b ON a.session = b.session AND a.security_id = b.security_id AND a.factor_id < b.factor_id),
r AS (SELECT factor_a, factor_b, rank() OVER (PARTITION BY factor_a, factor_b ORDER BY x) + (count(*) OVER (PARTITION BY factor_a, factor_b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY factor_a, factor_b ORDER BY y) + (count(*) OVER (PARTITION BY factor_a, factor_b, y) - 1) / 2.0 AS y FROM j),
c AS (SELECT factor_a, factor_b, corr(x, y) AS pooled FROM r GROUP BY 1, 2),
o AS (SELECT factor_a, factor_b, t.session, count(u.security_id) / count(*) AS o FROM c JOIN top t ON t.factor_id = factor_a LEFT JOIN top u ON u.factor_id = factor_b AND u.session = t.session AND u.security_id = t.security_id
  WHERE (factor_b, t.session) IN (SELECT factor_id, session FROM top) GROUP BY 1, 2, 3)
SELECT factor_a, factor_b, round(any_value(pooled), 6) + 0.0 AS pooled, round(avg(o), 6) + 0.0 AS overlap FROM c LEFT JOIN o USING (factor_a, factor_b) GROUP BY 1, 2""")
def ag_10(spark, sf_dir):
    """Spearman of each two factors over all sessions at once, and the shared part of their top sets over the size of the first."""
    s = dg.with_top(scores(spark, sf_dir), ["factor_id"]).where("score is not null")
    return dg.pooled_conflicts(s).select("factor_a", "factor_b", rounded(F.col("pooled")).alias("pooled"), rounded(F.col("overlap")).alias("overlap"))


@query("ag_11_group_ic", f"""{SQL_BASE}, both_ AS (SELECT *, security_id % 2 AS g FROM p WHERE score IS NOT NULL AND forward_return IS NOT NULL),
rk AS (SELECT factor_id, session, g, rank() OVER (PARTITION BY factor_id, session, g ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, session, g, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY factor_id, session, g ORDER BY forward_return) + (count(*) OVER (PARTITION BY factor_id, session, g, forward_return) - 1) / 2.0 AS y FROM both_)
SELECT factor_id, session, g, round(CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) + 0.0 AS ic FROM rk GROUP BY 1, 2, 3""")
def ag_11(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("g", F.col("security_id") % 2)
    return dg.rank_ic(p, ["factor_id", "session", "g"]).select("factor_id", "session", "g", rounded(F.col("ic")).alias("ic"))


@query("ag_20_composite_comparison", f"""{SQL_BASE}, r AS (SELECT factor_id, session, security_id, forward_return, CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY factor_id, session, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, session, score) - 1) / 2.0) / count(score) OVER (PARTITION BY factor_id, session) END AS x FROM p),
c AS (SELECT 'ALL' AS composite_id, session, security_id, any_value(forward_return) AS forward_return, round(avg(x), 9) AS score, count(x) AS n FROM r GROUP BY 2, 3 HAVING count(x) = 4 UNION ALL SELECT 'TWO', session, security_id, any_value(forward_return), round(avg(x), 9), count(x) FROM r WHERE factor_id IN ('reversal', 'activity') GROUP BY 2, 3 HAVING count(x) = 2),
rk AS (SELECT composite_id, session, rank() OVER (PARTITION BY composite_id, session ORDER BY score) + (count(*) OVER (PARTITION BY composite_id, session, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY composite_id, session ORDER BY forward_return) + (count(*) OVER (PARTITION BY composite_id, session, forward_return) - 1) / 2.0 AS y FROM c WHERE forward_return IS NOT NULL),
i AS (SELECT composite_id, session, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM rk GROUP BY 1, 2) SELECT composite_id, round(avg(ic), 6) + 0.0 AS mean_ic, count(ic) AS n_sessions FROM i GROUP BY 1""")
def ag_20(spark, sf_dir):
    """The same measure of two composites of different factors."""
    from tidepanel.operators.selection import composite

    p = pairs(spark, sf_dir).withColumn("share", cs.rank(F.col("score"), "factor_id", "session"))
    labels = p.select("session", "security_id", "forward_return").distinct()
    both = composite(p, 4).withColumn("composite_id", F.lit("ALL")).unionByName(composite(p.where("factor_id in ('reversal', 'activity')"), 2).withColumn("composite_id", F.lit("TWO")))
    c = both.withColumn("score", F.round("score", 9)).join(labels, ["session", "security_id"])
    return dg.ic_summary(dg.rank_ic(c, ["composite_id", "session"]), ["composite_id"]).select("composite_id", rounded(F.col("mean_ic")).alias("mean_ic"), "n_sessions")


@query("tk_10_review_list", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size > 10) SELECT p_brand, p_partkey FROM r WHERE k = 1")
def tk_10(spark, sf_dir):
    """The first of each mechanism among reviewed candidates."""
    best = read(spark, sf_dir, "part").where("p_size > 10").groupBy("p_brand").agg(F.min(F.struct((-F.col("p_retailprice")).alias("p"), "p_partkey")).alias("b"))
    return best.select("p_brand", "b.p_partkey")


@query("tk_11_session_scores", f"""WITH {SQL_EVENTS}, g AS (SELECT *, count(*) OVER () AS n, count(close) OVER () AS have FROM grid_e WHERE session = DATE '2024-01-17')
SELECT security_id, round((rank() OVER (ORDER BY close) + (count(*) OVER (PARTITION BY close) - 1) / 2.0) / have, 6) + 0.0 AS score, have < 0.95 * n AS thin, have < 500 AS few FROM g WHERE close IS NOT NULL""")
def tk_11(spark, sf_dir):
    """One session's scores with the blockers that would stop its use."""
    g = panels.event_grid(spark, sf_dir).where("session = date'2024-01-17'")
    w = cs.across()
    rows = g.withColumns({"n": F.count("*").over(w), "have": F.count("close").over(w), "score": rounded(cs.rank(F.col("close")))})
    return rows.where("close is not null").select("security_id", "score", (F.col("have") < 0.95 * F.col("n")).alias("thin"), (F.col("have") < 500).alias("few"))


@query("dq_07_14_16_release_gates", """SELECT 'PARTS' AS check, CASE WHEN count(*) >= 100 THEN 0 ELSE 1 END::BIGINT AS failed_rows FROM part UNION ALL SELECT 'FAMILIES_UNIQUE', count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM nation GROUP BY n_name) UNION ALL SELECT 'WEIGHTS', CASE WHEN abs(sum(w) - 1) < 1e-9 THEN 0 ELSE 1 END FROM (SELECT 1.0::DOUBLE / count(*) OVER () AS w FROM nation)""")
def dq_07(spark, sf_dir):
    part, nation = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    weights = nation.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy()))
    return part.agg(F.lit("PARTS").alias("check"), F.when(F.count("*") >= 100, 0).otherwise(1).cast("long").alias("failed_rows")).select("check", "failed_rows") \
        .unionByName(dq.unique_check(nation, "FAMILIES_UNIQUE", "n_name")).unionByName(weights.agg(F.lit("WEIGHTS").alias("check"), F.when(F.abs(F.sum("w") - 1) < 1e-9, 0).otherwise(1).cast("long").alias("failed_rows")).select("check", "failed_rows"))


@query("dq_15_maturity", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'E0' WHEN s_acctbal < 2000 THEN 'E1' WHEN s_acctbal < 4000 THEN 'E2' WHEN s_acctbal < 8000 THEN 'E3' ELSE 'E4' END AS level FROM supplier")
def dq_15(spark, sf_dir):
    b = F.col("s_acctbal")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (b >= 0).alias("computed"), (b >= 2000).alias("backtested"), (b >= 4000).alias("held_out"), (b >= 8000).alias("traded"))
    return s.select("s_suppkey", dq.maturity(s).alias("level"))


