"""Point-in-time panels in both modes, identity bridge, definitions and settlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.operators import asof
from tidepanel.plans.registry import query, rounded
from tidepanel.sources import panels
from tidepanel.sources.panels import SQL_VERSIONS, read

_SQL_MODES = f"""{SQL_VERSIONS}, v2 AS (SELECT *, available_at + (accession % 40)::INT AS seen_at FROM versions_l), cal AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS session FROM lineitem)"""


@query("fd_11_pit_modes", f"""WITH {_SQL_MODES}, m AS (SELECT 'HISTORICAL_DIAGNOSTIC' AS mode, session, security_id, field, arg_max((period_end, value), (period_end, v2.available_at, accession)) AS x FROM v2 JOIN cal ON v2.available_at <= session GROUP BY 2, 3, 4
UNION ALL SELECT 'FORWARD_OBSERVED', session, security_id, field, arg_max((period_end, value), (period_end, v2.available_at, accession)) FROM v2 JOIN cal ON greatest(v2.available_at, seen_at) <= session GROUP BY 2, 3, 4)
SELECT mode, security_id, field, session, x[1] AS period_end, round(x[2], 4) + 0.0 AS value FROM m WHERE session >= DATE '1996-01-01' AND session < DATE '2000-01-01'""")
def fd_11(spark, sf_dir):
    """Visibility by the mode's time, precedence by the historical one, clipped to a window of identity."""
    v = panels.versions(spark, sf_dir).withColumn("seen_at", F.date_add("available_at", (F.col("accession") % 40).cast("int")))
    v = v.withColumn("forward_at", F.greatest("available_at", "seen_at"))
    calendar = read(spark, sf_dir, "lineitem").select(F.last_day("l_shipdate").alias("session")).distinct()
    out = None
    for mode, known in (("HISTORICAL_DIAGNOSTIC", "available_at"), ("FORWARD_OBSERVED", "forward_at")):
        one = asof.pit_panel(v, calendar, ["security_id", "field"], known_at=known).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    out = out.where("session >= date'1996-01-01' and session < date'2000-01-01'")
    return out.select("mode", "security_id", "field", "session", "period_end", rounded(F.col("value"), 4).alias("value"))


@query("fd_15_16_identity_bridge", """WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal, n_name, CASE WHEN s_suppkey % 4 = 0 THEN 'ETF' WHEN s_suppkey % 4 = 1 THEN 'ADR' ELSE 'COMMON_STOCK' END AS kind, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey),
r AS (SELECT *, list_filter([CASE WHEN kind = 'ETF' THEN 'SECURITY_TYPE' END, CASE WHEN kind = 'ADR' THEN 'ADR' END, CASE WHEN n_name > 'M' THEN 'DOMICILE' END, CASE WHEN n > 5 THEN 'AMBIGUOUS' END], lambda x: x IS NOT NULL) AS r FROM s)
SELECT s_suppkey, array_to_string(r, '|') AS reasons, CASE WHEN s_suppkey % 10 = 3 THEN 'BLOCKED_BY_REVIEW' WHEN len(r) = 0 THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS status FROM r""")
def fd_15(spark, sf_dir):
    """Scope reasons of an issuer's securities, over which reviewed blocks are laid."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    per_issuer = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    s = s.join(per_issuer, "s_nationkey")
    key = F.col("s_suppkey")
    kind = sc.security_type(F.when(key % 4 == 0, "Wide ETF").when(key % 4 == 1, "Depositary").otherwise("Plain Inc"), {"ETF": r"\bETF\b", "ADR": "Depositary"})
    blocks = read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select("s_suppkey", F.lit(True).alias("blocked"))
    rows = s.withColumn("reasons", sc.reasons({"SECURITY_TYPE": kind == "ETF", "ADR": kind == "ADR", "DOMICILE": F.col("n_name") > "M", "AMBIGUOUS": F.col("n") > 5})).join(blocks, "s_suppkey", "left")
    status = F.when(F.col("blocked"), "BLOCKED_BY_REVIEW").when(F.size("reasons") == 0, "ELIGIBLE").otherwise("EXCLUDED")
    return rows.select("s_suppkey", F.concat_ws("|", "reasons").alias("reasons"), status.alias("status"))


@query("src_12_definition_import", "WITH d AS (SELECT p_brand AS id, p_type AS expression, p_size AS n FROM part) SELECT id, count(*) AS n_rows, count(DISTINCT expression || '#' || n) AS n_definitions FROM d GROUP BY 1")
def src_12(spark, sf_dir):
    """Definitions as JSON records: duplicates stay, equal content has one hash."""
    lines = read(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_brand").alias("id"), F.col("p_type").alias("expression"), F.col("p_size").alias("n"))).alias("line"))
    d = lines.select(F.from_json("line", "id string, expression string, n int").alias("d")).select("d.*")
    return d.withColumn("hash", sc.identity(F.col("expression"), F.col("n"))).groupBy("id").agg(F.count("*").alias("n_rows"), F.count_distinct("hash").alias("n_definitions"))


@query("ca_10_settlements", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'NO_OUTCOME' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'SETTLED' END AS state, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey")
def ca_10(spark, sf_dir):
    """Signals with their outcome or the reason for none."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").distinct()
    n = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "NO_OUTCOME").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SETTLED")
    return o.join(n, "o_orderkey", "left").select("o_orderkey", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("join_16_factor_pairs", "SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS shared FROM (SELECT DISTINCT p_brand, p_size FROM part) a JOIN (SELECT DISTINCT p_brand, p_size FROM part) b ON a.p_size = b.p_size AND a.p_brand < b.p_brand GROUP BY 1, 2")
def join_16(spark, sf_dir):
    """Pairs of factors on their common cells."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    a, b = (p.select(F.col("p_brand").alias(x), "p_size") for x in "ab")
    return a.join(b, "p_size").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
