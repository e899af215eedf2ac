"""Securities resolved to issuers, and identity rows at cutoffs, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import identity as idn
from tidepanel.plans.registry import query
from tidepanel.sources.panels import SQL_VERSIONS, read, versions
from tidepanel.sources.shared import written

_VENUES = ("NYSE", "New York  Stock Exchange", "NASDAQ", "Nasdaq Global Select", " NYSE ARCA", "nysearca", "Cboe BZX")
_FORMS = ("10-K", "20-F", "8-K")
#: Suppliers as securities; the same text in both dialects.
_UNIVERSE = {
    "ticker": "CASE WHEN s_suppkey % 29 = 0 THEN NULL ELSE concat('t', CAST(s_suppkey * 7 % 440 AS STRING), CASE WHEN s_suppkey % 5 = 0 THEN '.a' ELSE '' END) END",
    "venue": "CASE WHEN s_suppkey % 31 = 0 THEN 7 WHEN s_suppkey % 13 = 0 THEN (s_suppkey * 7 + 2) % 7 ELSE (s_suppkey * 7 % 440 + 400 * (s_suppkey % 3)) % 7 END",
    "security_type": "CASE WHEN s_suppkey % 17 = 0 THEN 'ETF' WHEN s_suppkey % 19 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'reit' ELSE 'Common_Stock' END",
    "domicile": "CASE WHEN s_suppkey % 23 = 0 THEN '' WHEN s_suppkey % 37 = 0 THEN 'Canada' ELSE 'usa' END",
    "name": "CASE WHEN s_suppkey % 41 = 0 THEN concat(s_name, ' Sponsored ADR') ELSE s_name END",
    "is_adr": "CASE WHEN s_suppkey % 43 = 0 THEN true WHEN s_suppkey % 2 = 0 THEN NULL ELSE false END",
}
#: Customers as issuers with a ticker, some with a second one.
_TICKER, _SECOND = "concat('T', CAST(c_custkey % 400 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '-A' ELSE '' END)", "concat('T', CAST((c_custkey + 1) % 400 AS STRING))"


def bridge(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    u = s.select(F.col("s_suppkey").alias("security_id"), *(F.expr(x).alias(k) for k, x in _UNIVERSE.items()))
    u = u.withColumn("exchange", F.get(F.array(*map(F.lit, _VENUES)), F.col("venue").cast("int")))
    year = F.make_date(1995 + F.col("security_id") % 2, F.lit(1), F.lit(1))
    u = u.withColumns({"effective_from": year, "effective_to": F.when(F.col("security_id") % 4 == 0, F.lit("1997-01-01").cast("date"))})
    place = (F.col("c_custkey") % 7).cast("int")
    forms = F.array(F.get(F.array(*map(F.lit, _FORMS)), F.when(F.col("c_custkey") % 11 == 0, 1).otherwise((F.col("c_custkey") % 2 * 2)).cast("int")))
    venue = lambda i: F.get(F.array(*map(F.lit, _VENUES)), i)
    first = c.select(F.col("c_custkey").alias("issuer"), F.expr(_TICKER).alias("sec_ticker"), venue(place).alias("sec_exchange"), F.lit(0).alias("position"), forms.alias("forms"))
    second = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("issuer"), F.expr(_SECOND).alias("sec_ticker"), venue(((F.col("c_custkey") + 1) % 7).cast("int")).alias("sec_exchange"), F.lit(1).alias("position"), forms.alias("forms"))
    return idn.resolve(u, first.unionByName(second))


def _dialect(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


_NAMES = "[" + ", ".join(f"'{v}'" for v in _VENUES) + "]"
_VENUE = "CASE WHEN {x} IS NULL THEN '' WHEN upper({x}) IN ('NYSE', 'NEW YORK  STOCK EXCHANGE') THEN 'NYSE' WHEN upper({x}) LIKE 'NASDAQ%' THEN 'NASDAQ' WHEN upper(trim({x})) IN ('NYSE ARCA', 'NYSEARCA') THEN 'NYSEARCA' ELSE replace(upper({x}), ' ', '') END"
_SQL_BRIDGE = f"""u AS (SELECT s_suppkey AS security_id, {", ".join(f"{_dialect(x)} AS {k}" for k, x in _UNIVERSE.items())}, make_date(1995 + s_suppkey % 2, 1, 1) AS f, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1997-01-01' END AS t FROM supplier),
v AS (SELECT *, replace(upper(coalesce(ticker, '')), '.', '-') AS nt, {_VENUE.format(x=f"{_NAMES}[venue + 1]")} AS ne, upper(coalesce(security_type, '')) AS k, upper(domicile) AS h FROM u),
x0 AS (SELECT c_custkey AS issuer, {_dialect(_TICKER)} AS tk, c_custkey % 7 AS venue, 0 AS place FROM customer UNION ALL SELECT c_custkey, {_dialect(_SECOND)}, (c_custkey + 1) % 7, 1 FROM customer WHERE c_custkey % 10 = 0),
x AS (SELECT x0.*, {_VENUE.format(x=f"{_NAMES}[venue + 1]")} AS ne, count(DISTINCT tk) OVER (PARTITION BY issuer) AS n FROM x0),
m AS (SELECT v.security_id, count(*) AS entries, count(DISTINCT issuer) AS issuers, count(DISTINCT issuer) FILTER (x.ne = v.ne) AS here, arg_min((issuer, tk, n), (issuer, place)) AS a, arg_min((issuer, tk, n), (issuer, place)) FILTER (x.ne = v.ne) AS b, bool_or(issuer % 11 = 0) AS abroad FROM v JOIN x ON x.tk = v.nt WHERE v.nt <> '' GROUP BY 1),
w AS (SELECT v.*, coalesce(entries, 0) AS entries, coalesce(issuers, 0) AS issuers, coalesce(here, 0) AS here, a, b, list_filter([CASE WHEN k NOT IN ('COMMON_STOCK', 'REIT') THEN 'UNSUPPORTED_SECURITY_TYPE:' || CASE WHEN k = '' THEN 'MISSING' ELSE k END END,
  CASE WHEN h = '' THEN 'MISSING_DOMICILE' WHEN h NOT IN ('US', 'USA', 'UNITED STATES', 'UNITED STATES OF AMERICA') THEN 'NON_US_DOMICILE:' || h END, CASE WHEN coalesce(is_adr, false) OR upper(name) LIKE '% ADR%' THEN 'ADR_EVIDENCE' END, CASE WHEN abroad THEN 'FOREIGN_FILING_FORM:20-F' END], lambda z: z IS NOT NULL) AS sc FROM v LEFT JOIN m USING (security_id)),
y AS (SELECT security_id, f, t, sc, CASE WHEN len(sc) > 0 THEN CASE WHEN here > 0 THEN CASE WHEN here = 1 THEN b END WHEN issuers = 1 THEN a END WHEN here = 1 AND nt <> '' AND ne <> '' THEN b END AS e,
  CASE WHEN len(sc) > 0 THEN 'DEFERRED_ISSUER_SCOPE' WHEN nt = '' OR ne = '' OR here <> 1 THEN 'UNRESOLVED' WHEN b[3] = 1 THEN 'VERIFIED_SINGLE_CLASS' ELSE 'VERIFIED_ENTITY_LEVEL_ONLY' END AS st,
  CASE WHEN len(sc) > 0 THEN array_to_string(sc, '|') WHEN nt = '' THEN 'MISSING_TICKER' WHEN ne = '' THEN 'MISSING_EXCHANGE' WHEN entries = 0 THEN 'TICKER_NOT_FOUND' WHEN here = 0 THEN 'EXCHANGE_CONFLICT' WHEN here > 1 THEN 'MULTIPLE_ISSUER_MATCHES' WHEN b[3] > 1 THEN 'ISSUER_HAS_MULTIPLE_SEC_TICKERS' ELSE '' END AS rs FROM w),
z AS (SELECT y.*, st LIKE 'VERIFIED%' AND EXISTS (SELECT 1 FROM y o WHERE o.st LIKE 'VERIFIED%' AND o.e[1] = y.e[1] AND o.security_id <> y.security_id AND (o.t IS NULL OR y.f < o.t) AND (y.t IS NULL OR o.f < y.t)) AS amb FROM y),
bridge AS (SELECT security_id, f AS effective_from, t AS effective_to, e[1] AS issuer, e[2] AS sec_ticker, nullif(regexp_extract(e[2], '[.-]([A-Z0-9]+)$', 1), '') AS share_class, CASE WHEN amb THEN 'AMBIGUOUS_MULTI_CLASS' ELSE st END AS mapping_status,
  CASE WHEN amb THEN concat_ws('|', nullif(rs, ''), 'MULTIPLE_PROJECT_SECURITIES_FOR_ISSUER') ELSE rs END AS blocking_reasons FROM z)"""


@query("join_07_issuer_bridge", f"WITH {_SQL_BRIDGE} SELECT * FROM bridge")
def join_07(spark, sf_dir):
    """All suppliers as securities, resolved by ticker and exchange to customers as issuers; scope and overlaps as reasons."""
    return bridge(spark, sf_dir)


@query("join_09_identity_at_cutoffs", f"""WITH {SQL_VERSIONS}, {_SQL_BRIDGE}, h AS (SELECT security_id, effective_from AS f, effective_to AS t, issuer, mapping_status FROM bridge UNION ALL SELECT security_id, DATE '1996-06-01', DATE '1998-06-01', issuer, mapping_status FROM bridge WHERE security_id % 4 = 0),
a AS (SELECT v.security_id, field, accession, period_end, available_at AS cutoff, CASE WHEN accession % 50 = 0 THEN -1 ELSE b.issuer END AS issuer, CASE field WHEN 'A' THEN 'STATEMENT' WHEN 'R' THEN 'market_cap' ELSE CASE WHEN accession % 9 = 0 THEN 'OTHER' ELSE 'shares' END END AS usage FROM versions_l v JOIN bridge b USING (security_id)),
c AS (SELECT a.*, (SELECT count(*) FROM h WHERE h.security_id = a.security_id AND h.f <= cutoff AND (h.t IS NULL OR cutoff < h.t)) AS n FROM a),
d AS (SELECT c.*, h.issuer AS hi, h.mapping_status AS hs FROM c LEFT JOIN h ON n = 1 AND h.security_id = c.security_id AND h.f <= cutoff AND (h.t IS NULL OR cutoff < h.t))
SELECT security_id, field, accession, period_end, n AS n_rows, CASE WHEN usage = 'OTHER' THEN 'IDENTITY_UNKNOWN_USAGE' WHEN n <> 1 THEN 'IDENTITY_INTERVAL_COUNT' WHEN hi IS DISTINCT FROM issuer THEN 'IDENTITY_ISSUER_MISMATCH' WHEN hs = 'VERIFIED_SINGLE_CLASS' OR (hs = 'VERIFIED_ENTITY_LEVEL_ONLY' AND usage = 'STATEMENT') THEN 'OK' ELSE 'IDENTITY_NOT_USABLE' END AS status FROM d""")
def join_09(spark, sf_dir):
    """Every fact of a supplier against the identity row of its time, which must be one, of its issuer and fit for its usage."""
    b = written(bridge(spark, sf_dir), "bridge")
    second = b.where("security_id % 4 = 0").withColumns({"effective_from": F.lit("1996-06-01").cast("date"), "effective_to": F.lit("1998-06-01").cast("date")})
    usage = F.when(F.col("field") == "A", "STATEMENT").when(F.col("field") == "R", "market_cap").when(F.col("accession") % 9 == 0, "OTHER").otherwise("shares")
    asked = versions(spark, sf_dir).join(b.select("security_id", "issuer"), "security_id")
    asked = asked.select("security_id", "field", "accession", "period_end", F.col("available_at").alias("cutoff"), F.when(F.col("accession") % 50 == 0, -1).otherwise(F.col("issuer")).alias("issuer"), usage.alias("usage"))
    return idn.usable(b.unionByName(second), asked).select("security_id", "field", "accession", "period_end", F.col("n_rows").cast("long").alias("n_rows"), "status")
