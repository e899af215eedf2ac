"""Filing documents, session times, bases, aligned inputs and cache names: driver tables are put into documents and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions.scalar import divide
from tidepanel.operators import asof
from tidepanel.operators.factor import Factor, apply, col, rank, ts_delta, ts_mean
from tidepanel.operators.fundamentals import inputs, periods
from tidepanel.operators.fundamentals.inputs import Binding
from tidepanel.operators.gates import HISTORICAL
from tidepanel.plans.factor_queries import SQL_BASE, scores
from tidepanel.plans.fundamental_queries import _SQL_QUARTERS, ledger_facts
from tidepanel.plans.registry import query, rounded
from tidepanel.sources import filings, panels, sessions, sinks
from tidepanel.sources.panels import SQL_VERSIONS, read

_SQL_LEDGER = """c AS (SELECT l_suppkey AS security_id, year(l_shipdate)::INT AS fy, quarter(l_shipdate) AS q, sum(round(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2, 3),
y AS (SELECT DISTINCT security_id, fy FROM c), d AS (SELECT security_id, fy, q.q, coalesce(v, 0) AS v FROM y CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q) q LEFT JOIN c USING (security_id, fy, q)),
k0 AS (SELECT security_id, fy, q, sum(v) OVER (PARTITION BY security_id, fy ORDER BY q) AS value, last_day(make_date(fy, (q * 3)::INT, 1)) AS period_end, 0 AS again FROM d),
k AS (SELECT *, CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END AS fp FROM (SELECT * FROM k0 UNION ALL SELECT security_id, fy, q, value + 10, period_end, 1 FROM k0 WHERE q = 4 AND security_id % 3 = 0))"""


@query("src_07_company_facts", f"""WITH {_SQL_LEDGER} SELECT lpad(security_id::VARCHAR, 10, '0') AS issuer, 'ledger' AS namespace, 'Revenues' AS tag, 'usd' AS unit, period_end, value::DOUBLE AS value, fy || '-' || fp || '-' || again AS accession, fy AS fiscal_year, fp AS fiscal_period,
CASE WHEN again = 1 THEN '10-K/A' WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form FROM k WHERE NOT (q = 2 AND security_id % 7 = 0)""")
def src_07(spark, sf_dir):
    """Each supplier's ledger as one nested document of facts, read back to rows; other forms are left out."""
    f = ledger_facts(spark, sf_dir)
    form = F.when((F.col("fiscal_period") == "Q2") & (F.col("security_id") % 7 == 0), "8-K").when(F.col("accession").endswith("-1"), "10-K/A").when(F.col("fiscal_period") == "FY", "10-K").otherwise("10-Q")
    one = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.col("accession").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), form.alias("form"), F.col("available_at").cast("string").alias("filed"))
    observed = f.groupBy("security_id").agg(F.sort_array(F.collect_list(one)).alias("all"))  # some thirty for each supplier
    unit = F.create_map(F.lit("USD"), F.col("all"))
    tags = F.create_map(F.lit("Revenues"), F.struct(F.lit("Revenues").alias("label"), unit.alias("units")))
    documents = observed.select(F.to_json(F.struct(F.col("security_id").alias("cik"), F.create_map(F.lit("ledger"), tags).alias("facts"))).alias("json"))
    return filings.company_facts(documents).select("issuer", "namespace", "tag", "unit", "period_end", "value", "accession", "fiscal_year", "fiscal_period", "form")


def _submissions(spark, sf_dir):
    """Each customer's orders as one nested document of filings: times as digits or ISO, some missing, some told twice."""
    k = F.col("o_orderkey")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(16), (k % 60).cast("int"))
    text = F.when(k % 5 == 0, None).when(k % 2 == 0, F.date_format(at, "yyyyMMddHHmmss")).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    o = read(spark, sf_dir, "orders").select("o_custkey", k.cast("string").alias("accession"), F.to_date("o_orderdate").cast("string").alias("filed"), text.alias("accepted"), F.date_format(F.col("o_orderdate"), "yyyyMMddHHmmss").alias("other"), (k % 9 == 0).alias("twice"))
    rows = o.select("o_custkey", "accession", "filed", F.explode(F.when(F.col("twice"), F.array("accepted", "other")).otherwise(F.array("accepted"))).alias("accepted"))
    lists = rows.groupBy("o_custkey").agg(F.collect_list(F.struct("accession", "filed", F.coalesce("accepted", F.lit("")).alias("accepted"))).alias("r"))
    recent = F.struct(F.col("r.accession").alias("accessionNumber"), F.col("r.filed").alias("filingDate"), F.col("r.accepted").alias("acceptanceDateTime"), F.transform("r", lambda x: F.lit("10-Q")).alias("form"))
    return lists.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("json"))


_SQL_INDEX = """a0 AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 16 HOUR + to_minutes(o_orderkey % 60) END AS t, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate END AS u FROM orders),
ix AS (SELECT lpad(o_custkey::VARCHAR, 10, '0') AS issuer, o_orderkey::VARCHAR AS accession, filed, (CASE WHEN t IS NULL THEN 0 ELSE 1 END) + (CASE WHEN u IS NOT NULL AND u IS DISTINCT FROM t THEN 1 ELSE 0 END) AS n, coalesce(t, u) AS one FROM a0),
idx AS (SELECT issuer, accession, filed, CASE WHEN n = 1 THEN one END AS accepted, CASE n WHEN 0 THEN 'DATE_ONLY' WHEN 1 THEN 'EXACT' ELSE 'CONFLICT' END AS status FROM ix)"""


@query("src_08_accession_index", f"WITH {_SQL_INDEX} SELECT issuer, accession, filed, accepted::TIMESTAMP AS accepted, status FROM idx")
def src_08(spark, sf_dir):
    """Accessions of submissions documents with one acceptance time, none, or several."""
    return filings.accessions(_submissions(spark, sf_dir)).select("issuer", "accession", "filed", F.col("accepted").cast("timestamp_ntz").alias("accepted"), "status")


@query("src_09_ticker_index", "SELECT s_suppkey::VARCHAR AS cik, upper(s_name) AS ticker, n_name AS exchange FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def src_09(spark, sf_dir):
    """A document of fields and rows for each nation, read back by field names."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = s.groupBy("n_nationkey").agg(F.collect_list(F.array(F.col("s_suppkey").cast("string"), F.upper("s_name"), F.col("n_name"))).alias("data"))
    documents = rows.select(F.to_json(F.struct(F.array(F.lit("CIK"), F.lit(" Ticker "), F.lit("exchange")).alias("fields"), "data")).alias("json"))
    return filings.ticker_index(documents).select(*(F.col("row")[c].alias(c) for c in ("cik", "ticker", "exchange")))


@query("fd_01_historical_availability", f"""WITH {_SQL_INDEX}, cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5),
n AS (SELECT filed, (SELECT min(session) FROM cal WHERE session > filed AND session <= filed + 14) AS nx FROM (SELECT DISTINCT filed FROM idx))
SELECT issuer, accession, coalesce(accepted + INTERVAL 10 MINUTE, nx + INTERVAL 21 HOUR)::TIMESTAMP AS historical_available_at, CASE WHEN accepted IS NOT NULL THEN 'EXACT' WHEN nx IS NOT NULL THEN 'NEXT_SESSION' ELSE 'UNKNOWN' END AS "precision" FROM idx JOIN n USING (filed)""")
def fd_01(spark, sf_dir):
    """When each filing could be known, by the index of accessions and the calendar of shipping days."""
    index = filings.accessions(_submissions(spark, sf_dir))
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct().where("dayofweek(session) between 2 and 6")
    calendar = days.withColumn("close_at", F.col("session").cast("timestamp") + F.expr("interval 21 hours"))
    out = filings.historical_availability(index.select("issuer", "accession", "filed"), index, calendar)
    return out.select("issuer", "accession", F.col("historical_available_at").cast("timestamp_ntz").alias("historical_available_at"), "precision")


@query("fd_03_mapping_status", """WITH f AS (SELECT l_returnflag AS tag, l_suppkey AS issuer, l_linestatus AS unit, CAST(l_shipdate AS DATE) AS filed, l_linenumber AS mode FROM lineitem GROUP BY ALL),
s AS (SELECT CASE WHEN mode % 3 = 0 THEN 'DEFERRED_DIMENSION' WHEN tag = 'R' THEN 'DEFERRED_CUSTOM_TAG' WHEN tag = 'N' THEN 'DEFERRED_SEMANTIC' WHEN unit <> 'F' THEN 'DEFERRED_UNIT_OR_BASIS' WHEN filed >= DATE '1997-01-01' THEN 'DEFERRED_SEMANTIC_AMBIGUITY' ELSE 'MAPPED' END AS status, tag FROM f)
SELECT tag, status, count(*) AS n, count(*) FILTER (status = 'MAPPED') AS named FROM s GROUP BY 1, 2""")
def fd_03(spark, sf_dir):
    """All six statuses of a mapping: facts of a part of the issuer first, then by tag, range, unit and number of best rows."""
    c = [("A", None, "F", "1990-01-01", None, 1, "returned"), ("A", None, "F", "1997-01-01", None, 1, "late"), ("N", None, "O", "2090-01-01", None, 1, "open")]
    c = spark.createDataFrame(c, "tag string, issuer long, unit string, valid_from string, valid_to string, priority int, field string").withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})
    mode = F.col("l_linenumber")
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tag"), F.col("l_suppkey").alias("issuer"), F.col("l_linestatus").alias("unit"), F.to_date("l_shipdate").alias("filed"), mode.alias("mode"), F.when(mode % 3 == 0, mode.cast("string")).otherwise(" ").alias("dimension")).distinct()
    out = asof.mapped(facts.withColumn("fact_id", F.struct("tag", "issuer", "unit", "filed", "mode")), c)
    return out.groupBy("fact_id.tag", "status").agg(F.count("*").alias("n"), F.count("field").alias("named"))


@query("wn_10_all_bases", f"""WITH {_SQL_LEDGER.replace('k AS (SELECT *', 'k_all AS (SELECT *')}, k AS (SELECT * FROM k_all WHERE q = 4 OR fy % 3 <> 0), {_SQL_QUARTERS.replace('c AS (', 'c2 AS (', 1).replace('FROM c)', 'FROM c2)').replace('JOIN c USING', 'JOIN c2 USING').replace('y AS (', 'y2 AS (').replace('FROM y ', 'FROM y2 ').replace('f AS (', 'f2 AS (').replace('FROM f ', 'FROM f2 ').replace('q AS (SELECT security_id, fy, ', 'q2 AS (SELECT security_id, fy, ')},
qd AS (SELECT * FROM q2 WHERE fy % 3 <> 0), e AS (SELECT e.security_id, e.available_at, v.period_end, arg_max(v.value, v.available_at) AS value FROM qd e JOIN qd v ON v.security_id = e.security_id AND v.available_at <= e.available_at GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY security_id, available_at ORDER BY period_end DESC) AS p FROM e), z AS (SELECT * FROM r WHERE p <= 4), g AS (SELECT *, date_diff('day', lag(period_end) OVER (PARTITION BY security_id, available_at ORDER BY period_end), period_end) AS gap FROM z),
t AS (SELECT security_id, available_at, max(period_end) AS period_end, sum(value) AS value FROM g GROUP BY 1, 2 HAVING count(*) = 4 AND min(coalesce(gap, 90)) >= 70 AND max(coalesce(gap, 90)) <= 120),
b AS (SELECT 'RAW' AS basis, 'SOURCE_LINKED_DIRECT' AS grade, value FROM k UNION ALL SELECT 'RAW', 'SOURCE_LINKED_DIRECT', value / 2 FROM k UNION ALL SELECT 'INSTANT', 'SOURCE_LINKED_DIRECT', value / 2 FROM k UNION ALL SELECT 'ANNUAL', 'SOURCE_LINKED_DIRECT', value FROM k WHERE q = 4
  UNION ALL SELECT 'QUARTERLY_DISCRETE', 'SOURCE_LINKED_DERIVED', value FROM qd UNION ALL SELECT 'TTM', 'SOURCE_LINKED_DERIVED', value FROM t UNION ALL SELECT 'TTM', 'HYPOTHESIS_PROXY', value FROM k WHERE q = 4 AND (security_id, period_end) NOT IN (SELECT security_id, period_end FROM t))
SELECT basis, grade, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM b GROUP BY 1, 2""")
def wn_10(spark, sf_dir):
    """Every basis of revenue and of a balance at each period's end; each third year lacks its quarters."""
    f = ledger_facts(spark, sf_dir).where("fiscal_period = 'FY' or fiscal_year % 3 != 0").withColumn("fact_type", F.lit("DURATION"))
    held = f.withColumns({"field": F.lit("assets"), "fact_type": F.lit("INSTANT"), "period_start": F.lit(None).cast("date"), "value": F.col("value") / 2})
    return periods.by_basis(f.unionByName(held)).groupBy("basis", "grade").agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("sc_25_session_bounds", """WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5), b AS (SELECT session, timezone('UTC', timezone('America/New_York', session + INTERVAL 570 MINUTE)) AS open_at,
timezone('UTC', timezone('America/New_York', session + CASE WHEN (month(session) = 12 AND day(session) = 24) OR (month(session) = 7 AND day(session) = 3) THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END)) AS close_at FROM cal)
SELECT o.session, open_at, close_at, CASE WHEN open_at IS NULL THEN 'NOT_A_SESSION' ELSE 'SESSION' END AS status, timezone('America/New_York', timezone('UTC', o.session + INTERVAL 12 HOUR)) AS noon FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders) o LEFT JOIN b USING (session)""")
def sc_25(spark, sf_dir):
    """Opening and closing times in UTC of the days of orders, through winter and summer time, with early closes."""
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct().where("dayofweek(session) between 2 and 6")
    early = F.date_format("session", "MM-dd").isin("12-24", "07-03")
    asked = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()
    out = sessions.bounds_of(asked, days.withColumn("early", early))
    return out.withColumn("noon", sessions.to_local(F.col("session").cast("timestamp_ntz") + F.expr("interval 12 hours")))


_BINDINGS = [Binding("R", "RAW"), Binding("A", "RAW"), Binding("N", "RAW", proxy=True)]
_SQL_INPUTS = f"""WITH {SQL_VERSIONS}, cal AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS session FROM lineitem),
pit AS (SELECT security_id, field, session, arg_max(accession, (period_end, v.available_at, accession)) AS acc, arg_max(value, (period_end, v.available_at, accession)) AS value FROM versions_l v JOIN cal ON v.available_at <= session GROUP BY 1, 2, 3),
kept AS (SELECT * FROM pit WHERE field = 'N' OR acc % 5 <> 0), w AS (SELECT session, security_id, max(value) FILTER (field = 'R') AS r, max(value) FILTER (field = 'A') AS a, max(value) FILTER (field = 'N') AS n FROM kept GROUP BY 1, 2),
g AS (SELECT session, security_id, r, a, n FROM (SELECT session FROM cal) CROSS JOIN (SELECT DISTINCT security_id FROM kept) LEFT JOIN w USING (session, security_id))"""


def _inputs(spark, sf_dir):
    """The month-end panel of three fields; values of each fifth accession only stand in."""
    calendar = panels.read(spark, sf_dir, "lineitem").select(F.last_day("l_shipdate").alias("session")).distinct()
    pit = asof.pit_panel(panels.versions(spark, sf_dir), calendar, ["security_id", "field"])
    grade = F.when(F.col("accession") % 5 == 0, inputs.PROXY).otherwise("SOURCE_LINKED_DIRECT")
    return inputs.aligned(pit.withColumns({"basis": F.lit("RAW"), "mode": F.lit(HISTORICAL), "grade": grade}), _BINDINGS, calendar)


@query("fd_13_aligned_inputs", f'{_SQL_INPUTS} SELECT session, security_id, round(r, 4) + 0.0 AS "R__RAW", round(a, 4) + 0.0 AS "A__RAW", round(n, 4) + 0.0 AS "N__RAW" FROM g')
def fd_13(spark, sf_dir):
    return _inputs(spark, sf_dir).select("session", "security_id", *(rounded(F.col(b.alias), 4).alias(b.alias) for b in _BINDINGS))


@query("fd_14_fundamental_factors", f"""{_SQL_INPUTS}, x AS (SELECT *, r - lag(r, 3) OVER w AS growth, CASE WHEN count(a) OVER (w ROWS 1 PRECEDING) = 2 THEN avg(a) OVER (w ROWS 1 PRECEDING) END AS level, r / nullif(a, 0) AS ratio FROM g WINDOW w AS (PARTITION BY security_id ORDER BY session))
SELECT session, security_id, round(growth, 4) + 0.0 AS growth, round(level, 4) + 0.0 AS level, round(CASE WHEN ratio IS NOT NULL THEN (rank() OVER (PARTITION BY session, ratio IS NULL ORDER BY ratio) + (count(*) OVER (PARTITION BY session, ratio) - 1) / 2.0) / count(ratio) OVER (PARTITION BY session) END, 6) + 0.0 AS cheap FROM x""")
def fd_14(spark, sf_dir):
    """Factors over aligned inputs, with the builder that prices use."""
    factors = [Factor("growth", ts_delta(col("R__RAW"), 3)), Factor("level", ts_mean(col("A__RAW"), 2)), Factor("cheap", rank(apply("ratio", divide, col("R__RAW"), col("A__RAW"))))]
    out = inputs.evaluated(_inputs(spark, sf_dir), _BINDINGS, factors)
    return out.select("session", "security_id", rounded(F.col("growth"), 4).alias("growth"), rounded(F.col("level"), 4).alias("level"), rounded(F.col("cheap")).alias("cheap"))


@query("snk_04_rank_contents", f"""{SQL_BASE}, r AS (SELECT factor_id, session, security_id, CAST(2 * rank() OVER (PARTITION BY factor_id, session ORDER BY score) + count(*) OVER (PARTITION BY factor_id, session, score) - 1 AS BIGINT) AS score FROM s WHERE score IS NOT NULL)
SELECT factor_id, 1 AS factor_version, count(*) AS n_rows, sum(CAST('0x' || substr(md5(concat_ws(chr(31), session::VARCHAR, security_id::VARCHAR, score::VARCHAR)), 1, 15) AS BIGINT))::VARCHAR AS content FROM r GROUP BY 1""")
def snk_04(spark, sf_dir):
    """Names of each factor's ranks by what they hold, under which a cache keeps them; ranks are doubled to be whole."""
    ranks = scores(spark, sf_dir).where("score is not null").withColumn("score", (2 * cs.average_rank(F.col("score"), "factor_id", "session")).cast("long"))
    return sinks.rank_contents(ranks.withColumn("factor_version", F.lit(1)))
