"""Factor diagnostics, selection and portfolios on the daily user grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions import scalar as sc
from tidepanel.functions import timeseries as ts
from tidepanel.operators import diagnostics as dg
from tidepanel.operators import portfolio as pf
from tidepanel.operators import selection as sel
from tidepanel.operators.factor import Factor, col, evaluate, long_form, ts_delta, ts_mean, ts_std_dev
from tidepanel.plans.registry import query, rounded
from tidepanel.sources import panels
from tidepanel.sources.panels import SQL_EVENTS, SQL_WEEKLY
from tidepanel.sources.shared import written

W = "PARTITION BY security_id ORDER BY session"
FACTORS = [
    Factor("reversal", -(col("close") / col("open") - 1)),
    Factor("momentum", ts_delta(col("close"), 3)),
    Factor("activity", ts_mean(col("volume"), 3)),
    Factor("calm", -ts_std_dev(col("close"), 3), delay=1),
]
SQL_FACTORS = f"""v AS (SELECT session, security_id, -(close / nullif(open, 0) - 1) AS reversal, close - lag(close, 3) OVER w AS momentum,
  CASE WHEN count(volume) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(volume) OVER (w ROWS 2 PRECEDING) END AS activity,
  CASE WHEN count(late) OVER (w ROWS 2 PRECEDING) = 3 THEN -stddev_pop(late) OVER (w ROWS 2 PRECEDING) END AS calm
  FROM (SELECT *, lag(close) OVER ({W}) AS late FROM grid_e) WINDOW w AS ({W})),
scores AS (SELECT session, security_id, factor_id, score FROM (UNPIVOT (SELECT session, security_id, coalesce(reversal, 'nan'::DOUBLE) AS reversal, coalesce(momentum, 'nan'::DOUBLE) AS momentum, coalesce(activity, 'nan'::DOUBLE) AS activity, coalesce(calm, 'nan'::DOUBLE) AS calm FROM v) ON reversal, momentum, activity, calm INTO NAME factor_id VALUE score)),
s AS (SELECT session, security_id, factor_id, CASE WHEN isnan(score) THEN NULL ELSE round(score, 9) END AS score FROM scores)"""
SQL_SIGNALS = """cal AS (SELECT DISTINCT session FROM bars_e), sig AS (SELECT session, row_number() OVER (ORDER BY session) AS ordinal, execution FROM (
  SELECT session, yearweek(session) AS wk, lead(yearweek(session)) OVER (ORDER BY session) AS nx, lead(session) OVER (ORDER BY session) AS execution FROM cal) WHERE nx <> wk)"""
SQL_RETURNS = f"""ret AS (SELECT session, security_id, CASE WHEN e > 0 THEN x / e - 1 END AS forward_return FROM (SELECT session, security_id, lead(open, 1) OVER w AS e, lead(open, 6) OVER w AS x FROM grid_e WINDOW w AS ({W})))"""
SQL_BASE = f"WITH {SQL_EVENTS}, {SQL_FACTORS}, {SQL_SIGNALS}, {SQL_RETURNS}, p AS (SELECT s.factor_id, s.session, s.security_id, s.score, r.forward_return FROM s JOIN sig USING (session) LEFT JOIN ret r ON r.session = s.session AND r.security_id = s.security_id)"
SQL_IC = """both_ AS (SELECT * FROM p WHERE score IS NOT NULL AND forward_return IS NOT NULL),
rk AS (SELECT factor_id, session, rank() OVER (PARTITION BY factor_id, session ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, session, score) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY factor_id, session ORDER BY forward_return) + (count(*) OVER (PARTITION BY factor_id, session, forward_return) - 1) / 2.0 AS y FROM both_),
ic AS (SELECT factor_id, session, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic, count(*) AS n FROM rk GROUP BY 1, 2)"""
SQL_TOP = "top AS (SELECT factor_id, session, security_id FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, session ORDER BY score DESC NULLS LAST, security_id) AS k, count(score) OVER (PARTITION BY factor_id, session) AS n FROM s) WHERE score IS NOT NULL AND k <= greatest(1, ceil(round(n * 0.1, 9))))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evaluate(panels.event_grid(spark, sf_dir), FACTORS)
    return long_form(wide, FACTORS).select("session", "security_id", "factor_id", F.round("value", 9).alias("score"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.signal_sessions(panels.read(spark, sf_dir, "events").select(F.to_date("ts").alias("session")))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.forward_returns(panels.event_grid(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scores(spark, sf_dir).join(F.broadcast(signals(spark, sf_dir).select("session")), "session")
    return at.join(returns(spark, sf_dir), ["session", "security_id"], "left")


@query("flagship_top_decile", f"""WITH {SQL_EVENTS}, r AS (SELECT session, security_id, -(close / nullif(open, 0) - 1) AS score FROM grid_e),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC NULLS LAST, security_id) AS place, greatest(1, ceil(round(count(score) OVER (PARTITION BY session) * 0.1, 9))) AS n FROM r)
SELECT session, security_id, place, round(0.95 / n, 9) AS weight FROM k WHERE score IS NOT NULL AND place <= n""")
def flagship(spark, sf_dir):
    """Events to daily bars, dense grid, reversal factor, top tenth of each session with 95 % in equal weights."""
    g = panels.event_grid(spark, sf_dir).withColumn("score", -(F.try_divide("close", "open") - 1))
    place = cs.descending_place(F.col("score"), F.col("security_id"))
    n = F.greatest(F.lit(1), F.ceil(F.round(F.count("score").over(cs.across()) * 0.1, 9)))
    rows = g.withColumns({"place": place, "n": n}).where("score is not null and place <= n")
    return rows.select("session", "security_id", F.col("place").cast("long").alias("place"), F.round(0.95 / F.col("n"), 9).alias("weight"))


@query("wn_01_02_signal_sessions", f"WITH {SQL_EVENTS}, {SQL_SIGNALS} SELECT session, ordinal, execution FROM sig")
def wn_01(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.select("session", F.col("ordinal").cast("long").alias("ordinal"), "execution")


@query("join_12_forward_returns", f"WITH {SQL_EVENTS}, {SQL_RETURNS} SELECT session, security_id, round(forward_return, 6) + 0.0 AS forward_return FROM ret")
def join_12(spark, sf_dir):
    return returns(spark, sf_dir).select("session", "security_id", rounded(F.col("forward_return")).alias("forward_return"))


@query("factor_batch_values", f"WITH {SQL_EVENTS}, {SQL_FACTORS} SELECT session, security_id, factor_id, round(score, 6) + 0.0 AS score FROM s")
def factor_batch(spark, sf_dir):
    return scores(spark, sf_dir).select("session", "security_id", "factor_id", rounded(F.col("score")).alias("score"))


@query("ag_01_rank_ic", f"{SQL_BASE}, {SQL_IC} SELECT factor_id, session, round(ic, 6) + 0.0 AS ic, n FROM ic")
def ag_01(spark, sf_dir):
    return dg.rank_ic(pairs(spark, sf_dir), ["factor_id", "session"]).select("factor_id", "session", rounded(F.col("ic")).alias("ic"), "n")


@query("ag_02_ic_summary", f"{SQL_BASE}, {SQL_IC} SELECT factor_id, round(avg(ic), 6) + 0.0 AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir, count(ic) AS n_sessions FROM ic GROUP BY 1")
def ag_02(spark, sf_dir):
    out = dg.ic_summary(dg.rank_ic(pairs(spark, sf_dir), ["factor_id", "session"]), ["factor_id"])
    return out.select("factor_id", rounded(F.col("mean_ic")).alias("mean_ic"), rounded(F.col("icir")).alias("icir"), "n_sessions")


@query("ag_03_04_yearly_ic", f"""{SQL_BASE}, {SQL_IC}, y AS (SELECT factor_id, year(session) AS year, avg(ic) AS m, count(*) AS n FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN n >= 4 THEN 'FULL_YEAR' WHEN year = max(year) OVER (PARTITION BY factor_id) AND n >= 2 THEN 'PARTIAL_YEAR' ELSE 'INSUFFICIENT' END AS status FROM y),
r AS (SELECT factor_id, avg(CASE WHEN status <> 'INSUFFICIENT' THEN CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END END)::DOUBLE AS positive_year_ratio FROM t GROUP BY 1)
SELECT factor_id, year::INT AS year, round(m, 6) + 0.0 AS mean_ic, n, status, positive_year_ratio FROM t JOIN r USING (factor_id)""")
def ag_03(spark, sf_dir):
    years = dg.yearly_ic(dg.rank_ic(pairs(spark, sf_dir), ["factor_id", "session"]), ["factor_id"], whole=4, partial=2)
    out = years.join(dg.positive_years(years, ["factor_id"]), "factor_id")
    return out.select("factor_id", "year", rounded(F.col("mean_ic")).alias("mean_ic"), "n", "status", "positive_year_ratio")


@query("ag_05_coverage", f"{SQL_BASE}, c AS (SELECT factor_id, session, count(*) FILTER (score IS NOT NULL AND forward_return IS NOT NULL) / count(*) AS x FROM p GROUP BY 1, 2) SELECT factor_id, round(median(x), 6) + 0.0 AS median_coverage FROM c GROUP BY 1")
def ag_05(spark, sf_dir):
    return dg.coverage(pairs(spark, sf_dir), ["factor_id"]).select("factor_id", rounded(F.col("median_coverage")).alias("median_coverage"))


_SQL_BUCKETS = """b AS (SELECT *, least(greatest(ceil(round((rank() OVER (PARTITION BY factor_id, session, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, session, score) - 1) / 2.0) / count(score) OVER (PARTITION BY factor_id, session), 9) * 5), 1), 5) AS bucket FROM p)"""


@query("ag_06_quantile_means", f"""{SQL_BASE}, {_SQL_BUCKETS}, m AS (SELECT factor_id, {", ".join(f"avg(forward_return) FILTER (bucket = {i}) AS q{i}" for i in range(1, 6))} FROM b WHERE score IS NOT NULL AND forward_return IS NOT NULL GROUP BY 1)
SELECT factor_id, {", ".join(f"round(q{i}, 6) + 0.0 AS q{i}_mean" for i in range(1, 6))}, round(q5 - q1, 6) + 0.0 AS spread FROM m""")
def ag_06(spark, sf_dir):
    out = dg.quantile_means(pairs(spark, sf_dir), ["factor_id"])
    return out.select("factor_id", *(rounded(F.col(c)).alias(c) for c in out.columns if c != "factor_id"))


@query("ag_07_top_turnover", f"""{SQL_BASE}, {SQL_TOP}, t AS (SELECT factor_id, ordinal, security_id FROM top JOIN sig USING (session)), z AS (SELECT DISTINCT factor_id, ordinal FROM t),
r AS (SELECT a.factor_id, z.ordinal, 1 - count(b.security_id) / count(*) AS x FROM t a JOIN z ON z.factor_id = a.factor_id AND z.ordinal = a.ordinal + 1 LEFT JOIN t b ON b.factor_id = a.factor_id AND b.ordinal = z.ordinal AND b.security_id = a.security_id GROUP BY 1, 2)
SELECT factor_id, round(avg(x), 6) + 0.0 AS turnover FROM r GROUP BY 1""")
def ag_07(spark, sf_dir):
    return dg.top_turnover(scores(spark, sf_dir), signals(spark, sf_dir), ["factor_id"]).select("factor_id", rounded(F.col("turnover")).alias("turnover"))


#: Weekly factors: factor, family, mechanism, semantic status. The catalogue also has two that can't be computed.
WEEKLY = [
    (Factor("level", -col("close")), "level", "value", "FULL_INTENT"),
    (Factor("level_4", -ts_mean(col("close"), 4)), "level", "value", "FULL_INTENT"),
    (Factor("level_12", -ts_mean(col("close"), 12)), "level_slow", "value", "PARTIAL_INTENT"),
    (Factor("level_26", -ts_mean(col("close"), 26)), "level_slow", "value", "FULL_INTENT"),
    (Factor("level_14", -ts_mean(col("close"), 14)), "level_mid", "value", "FULL_INTENT"),
    (Factor("momentum", ts_delta(col("close"), 4)), "momentum", "momentum", "FULL_INTENT"),
    (Factor("calm", -ts_std_dev(col("close"), 12)), "risk", "risk", "FULL_INTENT"),
    (Factor("activity", ts_mean(col("volume"), 8)), "activity", "liquidity", "PARTIAL_INTENT"),
    (Factor("reversal", -(col("close") / col("open") - 1)), "reversal", "reversal", "FULL_INTENT"),
    (Factor("thin", col("close") / col("traded")), "thin", "liquidity", "FULL_INTENT"),
]
INELIGIBLE = [("orders", "flow", "flow", "PROXY_ONLY"), ("headcount", "staff", "staff", "PROXY_ONLY")]
_CATALOGUE = [(f.name, 1, family, mechanism, semantic, f.warmup, True) for f, family, mechanism, semantic in WEEKLY] + [(n, 1, family, mechanism, semantic, 0, False) for n, family, mechanism, semantic in INELIGIBLE]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CATALOGUE, "factor_id string, factor_version int, family_id string, mechanism_tag string, semantic_status string, warmup_sessions int, eligible boolean")


def weekly_scores(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each week and security: forward_return, columns of the panel to ``keep`` and a column for each weekly factor (or
    those named), off one grid."""
    factors = [f for f, *_ in WEEKLY if not names or f.name in names]
    wide = evaluate(dg.with_forward_returns(panels.weekly_panel(spark, sf_dir)), factors, keep=("forward_return", *keep))
    return wide.withColumns({f.name: sc.rounded(F.col(f.name), 9) for f in factors})


def weekly_sections(spark: SparkSession, sf_dir: str, pairs: bool = False) -> DataFrame:
    """Cross-sections of all weekly factors at signal sessions."""
    sig = dg.signal_sessions(panels.supplier_sessions(spark, sf_dir))
    wide = weekly_scores(spark, sf_dir).join(F.broadcast(sig.select("session")), "session")
    return dg.cross_sections(wide, [f.name for f, *_ in WEEKLY], panels.tasks(panels.read(spark, sf_dir, "lineitem")), pairs=pairs, benchmark=panels.BENCHMARK)


_MEAN_OF = lambda n: f"CASE WHEN count(close) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN -avg(close) OVER (w ROWS {n - 1} PRECEDING) END"
SQL_WEEKLY_PAIRS = f"""WITH RECURSIVE {SQL_WEEKLY}, wf AS (SELECT session, security_id, CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 6) OVER w / lead(open, 1) OVER w - 1 END AS forward_return,
  -close AS level, {_MEAN_OF(4)} AS level_4, {_MEAN_OF(12)} AS level_12, {_MEAN_OF(26)} AS level_26, {_MEAN_OF(14)} AS level_14, close - lag(close, 4) OVER w AS momentum,
  CASE WHEN count(close) OVER (w ROWS 11 PRECEDING) = 12 THEN -stddev_pop(close) OVER (w ROWS 11 PRECEDING) END AS calm,
  CASE WHEN count(volume) OVER (w ROWS 7 PRECEDING) = 8 THEN avg(volume) OVER (w ROWS 7 PRECEDING) END AS activity,
  -(close / nullif(open, 0) - 1) AS reversal, close / nullif(traded, 0) AS thin FROM week_l WINDOW w AS ({W})),
sig AS (SELECT session, row_number() OVER (ORDER BY session) AS ordinal FROM (SELECT session, yearweek(session) AS wk, lead(yearweek(session)) OVER (ORDER BY session) AS nx FROM (SELECT DISTINCT session FROM bars_l)) WHERE nx <> wk),
p AS (SELECT session, ordinal, security_id, factor_id, round(score, 9) AS score, forward_return FROM ({" UNION ALL ".join(f"SELECT session, security_id, '{f.name}' AS factor_id, {f.name} AS score, forward_return FROM wf" for f, *_ in WEEKLY)}) JOIN sig USING (session))"""
SQL_DIAGNOSED = f"""{SQL_WEEKLY_PAIRS}, {SQL_IC},
yr AS (SELECT factor_id, year(session) AS y, avg(ic) AS m, count(*) AS n, max(year(session)) OVER (PARTITION BY factor_id) AS last FROM ic WHERE ic IS NOT NULL GROUP BY factor_id, year(session)),
pos AS (SELECT factor_id, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS positive_year_ratio FROM yr WHERE n >= 26 OR (y = last AND n >= 13) GROUP BY 1),
ics AS (SELECT factor_id, count(ic) AS n_sessions, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM ic GROUP BY 1),
cov AS (SELECT factor_id, median(x) AS median_coverage FROM (SELECT factor_id, session, count(*) FILTER (score IS NOT NULL AND forward_return IS NOT NULL) / count(*) AS x FROM p GROUP BY 1, 2) GROUP BY 1),
bk AS (SELECT *, least(greatest(ceil(round((rank() OVER (PARTITION BY factor_id, session, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, session, score) - 1) / 2.0) / count(score) OVER (PARTITION BY factor_id, session), 9) * 5), 1), 5) AS bucket FROM p),
qm AS (SELECT factor_id, {", ".join(f"avg(forward_return) FILTER (bucket = {i}) AS q{i}_mean" for i in range(1, 6))} FROM bk WHERE score IS NOT NULL AND forward_return IS NOT NULL GROUP BY 1),
tp AS (SELECT factor_id, ordinal, security_id FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, session ORDER BY score DESC NULLS LAST, security_id) AS k, count(score) OVER (PARTITION BY factor_id, session) AS n FROM p) WHERE score IS NOT NULL AND k <= greatest(1, ceil(round(n * 0.1, 9)))),
tn AS (SELECT factor_id, avg(x) AS turnover FROM (SELECT a.factor_id, a.ordinal, 1 - count(b.security_id) / count(*) AS x FROM tp a LEFT JOIN tp b ON b.factor_id = a.factor_id AND b.security_id = a.security_id AND b.ordinal = a.ordinal + 1 WHERE a.ordinal < (SELECT max(ordinal) FROM sig) GROUP BY 1, 2) GROUP BY 1),
dx AS (SELECT factor_id, n_sessions, median_coverage, mean_ic, icir, positive_year_ratio, {", ".join(f"q{i}_mean" for i in range(1, 6))}, turnover, q5_mean - q1_mean AS spread
  FROM ics LEFT JOIN pos USING (factor_id) LEFT JOIN cov USING (factor_id) LEFT JOIN qm USING (factor_id) LEFT JOIN tn USING (factor_id))"""


@query("ag_08_diagnose", f"""{SQL_DIAGNOSED} SELECT factor_id, n_sessions, {", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("median_coverage", "mean_ic", "icir", "positive_year_ratio", "q1_mean", "q2_mean", "q3_mean", "q4_mean", "q5_mean", "turnover", "spread"))} FROM dx""")
def ag_08(spark, sf_dir):
    """All diagnostics of ten weekly factors in one pass."""
    out = dg.diagnosed(weekly_sections(spark, sf_dir))
    return out.select("factor_id", "n_sessions", *(rounded(F.col(c), 9).alias(c) for c in out.columns if c not in ("factor_id", "n_sessions")))


def _sql_redundancy(rows: str) -> str:
    """CTEs ending in ``rd`` over rows (factor_id, session, security_id, score)."""
    tops = ", ".join(f"row_number() OVER (PARTITION BY factor_a, factor_b, session ORDER BY {x} DESC, security_id) <= greatest(1, ceil(round(count(*) OVER (PARTITION BY factor_a, factor_b, session) * 0.1, 9))) AS t{x}" for x in "xy")
    ranks = ", ".join(f"rank() OVER (PARTITION BY factor_a, factor_b, session ORDER BY {x}) + (count(*) OVER (PARTITION BY factor_a, factor_b, session, {x}) - 1) / 2.0 AS r{x}" for x in "xy")
    return f"""fr AS ({rows}), qr AS (SELECT a.factor_id AS factor_a, b.factor_id AS factor_b, a.session, a.security_id, a.score AS x, b.score AS y FROM fr a JOIN fr b ON a.session = b.session AND a.security_id = b.security_id AND a.factor_id < b.factor_id),
kr AS (SELECT *, {tops}, {ranks} FROM qr),
cr AS (SELECT factor_a, factor_b, session, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 1e-12 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic, count(*) FILTER (tx AND ty) / count(*) FILTER (tx OR ty) AS j FROM kr GROUP BY 1, 2, 3),
rd AS (SELECT factor_a, factor_b, median(abs(ic)) AS median_abs_ic, avg(j) AS top_jaccard FROM cr GROUP BY 1, 2)"""


@query("ag_09_redundancy", f"{SQL_BASE}, {_sql_redundancy('SELECT factor_id, session, security_id, score FROM p WHERE score IS NOT NULL')} SELECT factor_a, factor_b, round(median_abs_ic, 6) + 0.0 AS median_abs_ic, round(top_jaccard, 6) + 0.0 AS top_jaccard FROM rd")
def ag_09(spark, sf_dir):
    """Pairs of the daily factors, which all miss different rows."""
    at = scores(spark, sf_dir).join(F.broadcast(signals(spark, sf_dir).select("session")), "session")
    return dg.redundancy(at).select("factor_a", "factor_b", rounded(F.col("median_abs_ic")).alias("median_abs_ic"), rounded(F.col("top_jaccard")).alias("top_jaccard"))


@query("ag_12_bucket_returns", f"{SQL_BASE}, {_SQL_BUCKETS} SELECT factor_id, CAST(bucket AS BIGINT) AS bucket, round(avg(forward_return), 6) + 0.0 AS mean, round(stddev_samp(forward_return) / sqrt(count(*)), 6) + 0.0 AS error FROM b WHERE score IS NOT NULL AND forward_return IS NOT NULL GROUP BY 1, 2")
def ag_12(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("bucket", cs.bucket(F.round(cs.rank(F.col("score"), "factor_id", "session"), 9), 5)).where("score is not null and forward_return is not null")
    out = p.groupBy("factor_id", F.col("bucket").cast("long").alias("bucket")).agg(F.avg("forward_return").alias("mean"), (F.stddev_samp("forward_return") / F.sqrt(F.count("*"))).alias("error"))
    return out.select("factor_id", "bucket", rounded(F.col("mean")).alias("mean"), rounded(F.col("error")).alias("error"))


@query("ag_13_rank_autocorrelation", f"""{SQL_BASE}, r AS (SELECT factor_id, s.session, ordinal, security_id, rank() OVER (PARTITION BY factor_id, s.session ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, s.session, score) - 1) / 2.0 AS r FROM s JOIN sig USING (session) WHERE score IS NOT NULL)
SELECT a.factor_id, a.session, round(CASE WHEN stddev_pop(a.r) * stddev_pop(b.r) > 1e-12 THEN covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)) END, 6) + 0.0 AS autocorrelation FROM r a JOIN r b ON b.factor_id = a.factor_id AND b.security_id = a.security_id AND b.ordinal = a.ordinal - 1 GROUP BY 1, 2""")
def ag_13(spark, sf_dir):
    return dg.rank_autocorrelation(scores(spark, sf_dir), signals(spark, sf_dir)).select("factor_id", "session", rounded(F.col("autocorrelation")).alias("autocorrelation"))


@query("ag_14_bucket_turnover", f"""{SQL_BASE}, {_SQL_BUCKETS}, k AS (SELECT factor_id, CAST(bucket AS BIGINT) AS bucket, ordinal, security_id FROM b JOIN sig USING (session) WHERE score IS NOT NULL)
SELECT a.factor_id, a.bucket, a.ordinal, round(1 - count(b.security_id) / count(*), 6) + 0.0 AS turnover FROM k a LEFT JOIN k b ON b.factor_id = a.factor_id AND b.bucket = a.bucket AND b.security_id = a.security_id AND b.ordinal = a.ordinal - 1
WHERE a.ordinal > (SELECT min(ordinal) FROM k c WHERE c.factor_id = a.factor_id) GROUP BY 1, 2, 3""")
def ag_14(spark, sf_dir):
    at = scores(spark, sf_dir).join(F.broadcast(signals(spark, sf_dir)), "session").where("score is not null")
    b = at.select("factor_id", cs.bucket(F.round(cs.rank(F.col("score"), "factor_id", "session"), 9), 5).cast("long").alias("bucket"), F.col("ordinal").cast("long").alias("ordinal"), "security_id")
    return dg.bucket_turnover(b).withColumn("turnover", rounded(F.col("turnover")))


@query("ag_15_decile_table", f"""{SQL_BASE}, d AS (SELECT *, ntile(10) OVER (PARTITION BY session ORDER BY score, security_id) AS g FROM p WHERE factor_id = 'reversal' AND score IS NOT NULL)
SELECT session, CAST(g AS BIGINT) AS decile, round(avg(forward_return), 6) + 0.0 AS mean, count(*) AS eligible, count(forward_return) AS valid FROM d GROUP BY 1, 2""")
def ag_15(spark, sf_dir):
    p = pairs(spark, sf_dir).where("factor_id = 'reversal' and score is not null").withColumn("decile", cs.positional_deciles(F.col("score"), F.col("security_id"), 10).cast("long"))
    out = p.groupBy("session", "decile").agg(F.avg("forward_return").alias("mean"), F.count("*").alias("eligible"), F.count("forward_return").alias("valid"))
    return out.withColumn("mean", rounded(F.col("mean")))


@query("ag_17_value_coverage", f"""WITH {SQL_EVENTS}, {SQL_FACTORS}, c AS (SELECT factor_id, session, count(score) AS n, count(*) AS m FROM s GROUP BY 1, 2)
SELECT factor_id, min(n) AS least, median(n)::DOUBLE AS middle, max(n) AS most, min(session) FILTER (n >= 2) AS first_session, max(session) FILTER (n >= 2) AS last_session, round(1 - sum(n) / sum(m), 6) + 0.0 AS missing FROM c GROUP BY 1""")
def ag_17(spark, sf_dir):
    c = scores(spark, sf_dir).groupBy("factor_id", "session").agg(F.count("score").alias("n"), F.count("*").alias("m"))
    day = F.when(F.col("n") >= 2, F.col("session"))
    return c.groupBy("factor_id").agg(F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.min(day).alias("first_session"), F.max(day).alias("last_session"), rounded(1 - F.sum("n") / F.sum("m")).alias("missing"))


@query("ag_25_long_short", f"""{SQL_BASE}, d AS (SELECT *, (row_number() OVER (PARTITION BY factor_id, session ORDER BY score, security_id) - 1) AS k, count(*) OVER (PARTITION BY factor_id, session) AS n FROM p WHERE score IS NOT NULL),
w AS (SELECT *, CASE WHEN least(10, k * 10 // n + 1) = 10 THEN 0.5 WHEN least(10, k * 10 // n + 1) = 1 THEN -0.5 END AS side, least(10, k * 10 // n + 1) AS g FROM d), e AS (SELECT *, side / count(*) OVER (PARTITION BY factor_id, session, g) AS w FROM w WHERE side IS NOT NULL)
SELECT factor_id, session, round(CASE WHEN count(*) = count(forward_return) THEN sum(w * forward_return) END, 6) + 0.0 AS value FROM e GROUP BY 1, 2""")
def ag_25(spark, sf_dir):
    """Return of the best tenth less that of the worst; one missing label blocks the session."""
    by = ("factor_id", "session")
    p = pairs(spark, sf_dir).where("score is not null").withColumn("g", cs.integer_deciles(F.col("score"), F.col("security_id"), 10, *by))
    side = F.when(F.col("g") == 10, 0.5).when(F.col("g") == 1, -0.5)
    e = p.withColumn("side", side).where("side is not null").withColumn("w", F.col("side") / F.count("*").over(cs.across(*by, "g")))
    value = F.when(F.count("*") == F.count("forward_return"), F.sum(F.col("w") * F.col("forward_return")))
    return e.groupBy(*by).agg(rounded(value).alias("value"))


_P = sel.POLICY
_SQL_GATES = f"""cat(factor_id, factor_version, family_id, mechanism_tag, semantic_status, warmup_sessions, eligible) AS (VALUES {", ".join(str(r).replace("True", "true").replace("False", "false") for r in _CATALOGUE)}),
gt AS (SELECT dx.*, CASE WHEN n_sessions IS NULL OR median_coverage IS NULL THEN 'REJECT_DATA/MISSING_DATA_DIAGNOSTIC' WHEN median_coverage < {_P["min_median_coverage"]} THEN 'REJECT_DATA/MEDIAN_COVERAGE_BELOW_MINIMUM'
  WHEN n_sessions < {_P["min_sessions"]} THEN 'REJECT_DATA/VALID_SIGNAL_SESSIONS_BELOW_MINIMUM' WHEN mean_ic IS NULL OR spread IS NULL THEN 'REJECT_SIGNAL/MISSING_SIGNAL_DIAGNOSTIC' WHEN mean_ic <= 0 THEN 'REJECT_SIGNAL/NONPOSITIVE_MEAN_RANK_IC'
  WHEN spread <= 0 THEN 'REJECT_SIGNAL/NONPOSITIVE_Q5_MINUS_Q1' WHEN positive_year_ratio IS NULL THEN 'WATCHLIST_UNSTABLE/MISSING_POSITIVE_YEAR_RATIO' WHEN positive_year_ratio < {_P["min_positive_years"]} THEN 'WATCHLIST_UNSTABLE/POSITIVE_YEAR_RATIO_BELOW_MINIMUM'
  WHEN turnover IS NULL THEN 'WATCHLIST_HIGH_TURNOVER/MISSING_WEEKLY_TOP10_TURNOVER' WHEN turnover > {_P["max_turnover"]} THEN 'WATCHLIST_HIGH_TURNOVER/WEEKLY_TOP10_TURNOVER_ABOVE_MAXIMUM' ELSE 'PASS_GATES/PASS_ALL_GATES' END AS said FROM dx)"""
SQL_GATED = f"{SQL_DIAGNOSED}, {_SQL_GATES}"
SQL_SELECTED = f"""{SQL_GATED}, ps AS (SELECT *, row_number() OVER (ORDER BY positive_year_ratio DESC NULLS LAST, icir DESC NULLS LAST, mean_ic DESC NULLS LAST, spread DESC NULLS LAST, turnover NULLS LAST, median_coverage DESC NULLS LAST,
  CASE semantic_status WHEN 'FULL_INTENT' THEN 0 WHEN 'PARTIAL_INTENT' THEN 1 ELSE 2 END, warmup_sessions NULLS LAST, factor_id, factor_version) AS place FROM gt JOIN cat USING (factor_id) WHERE said LIKE 'PASS%'),
{_sql_redundancy("SELECT factor_id, session, security_id, score FROM p WHERE score IS NOT NULL AND factor_id IN (SELECT factor_id FROM ps)")},
cf AS (SELECT a.factor_id AS factor_a, b.factor_id AS factor_b, a.family_id = b.family_id AS same_family, a.mechanism_tag = b.mechanism_tag AS same_mechanism, median_abs_ic, top_jaccard,
  array_to_string(list_filter([CASE WHEN a.family_id = b.family_id THEN 'SAME_FAMILY' END, CASE WHEN median_abs_ic > {_P["score_corr_conflict"]} THEN 'SCORE_CORRELATION' END, CASE WHEN top_jaccard > {_P["top_overlap_conflict"]} THEN 'TOP10_OVERLAP' END], lambda x: x IS NOT NULL), '|') AS conflict_reason
  FROM ps a JOIN ps b ON a.factor_id < b.factor_id LEFT JOIN rd ON factor_a = a.factor_id AND factor_b = b.factor_id),
nr AS (SELECT ps.factor_id, place, coalesce((SELECT list(CASE WHEN factor_a = ps.factor_id THEN factor_b ELSE factor_a END) FROM cf WHERE conflict_reason <> '' AND (factor_a = ps.factor_id OR factor_b = ps.factor_id)), []) AS near FROM ps),
gy AS (SELECT 0::BIGINT AS place, ''::VARCHAR AS factor_id, []::VARCHAR[] AS taken, ''::VARCHAR AS status, ''::VARCHAR AS reason
  UNION ALL SELECT nr.place, nr.factor_id, CASE WHEN len(list_filter(taken, lambda t: list_contains(near, t))) > 0 OR len(taken) >= {_P["pool_max"]} THEN taken ELSE list_append(taken, nr.factor_id) END,
    CASE WHEN len(list_filter(taken, lambda t: list_contains(near, t))) > 0 THEN 'REJECT_REDUNDANT' WHEN len(taken) >= {_P["pool_max"]} THEN 'REJECT_POOL_CAP' ELSE 'SELECTED' END,
    CASE WHEN len(list_filter(taken, lambda t: list_contains(near, t))) > 0 THEN 'REJECT_REDUNDANT_WITH_' || list_filter(taken, lambda t: list_contains(near, t))[1] WHEN len(taken) >= {_P["pool_max"]} THEN 'ACTIVE_POOL_MAX_REACHED' ELSE 'SELECTED_NONREDUNDANT' END
    FROM gy JOIN nr ON nr.place = gy.place + 1)"""


def gated(spark: SparkSession, sf_dir: str, pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(decided, sections): diagnostics of the weekly factors with their outcome, a row for each, and the cross-sections that they
    are of, with those of all two factors. Both are written once, as selection reads them several times."""
    sections = written(weekly_sections(spark, sf_dir, pairs), "weekly-sections")
    return written(sel.gated(dg.diagnosed(sections)), "gates"), sections


def passing(spark: SparkSession, decided: DataFrame) -> DataFrame:
    return decided.where("status = 'PASS_GATES'").join(F.broadcast(catalogue(spark)), "factor_id")


def conflicts(sections: DataFrame, good: DataFrame) -> DataFrame:
    """Conflicts among the passing factors."""
    return sel.conflicts(good, dg.redundant(sections))


def selected(spark: SparkSession, decided: DataFrame, sections: DataFrame) -> DataFrame:
    good = passing(spark, decided)
    ranked = good.select("factor_id", F.row_number().over(Window.orderBy(*sel.candidate_order())).alias("place"))  # a catalogue
    return sel.greedy(ranked, conflicts(sections, good).where("hard_conflict"), most=_P["pool_max"])


@query("tk_06_gates", f"{SQL_GATED} SELECT factor_id, split_part(said, '/', 1) AS status, split_part(said, '/', 2) AS reason FROM gt")
def tk_06(spark, sf_dir):
    """Ordered gates over the diagnostics, with the reason of the first that stops a factor."""
    return gated(spark, sf_dir, pairs=False)[0].select("factor_id", "status", "reason")


@query("tk_08_conflicts", f"{SQL_SELECTED} SELECT factor_a, factor_b, same_family, same_mechanism, round(median_abs_ic, 6) + 0.0 AS median_abs_ic, round(top_jaccard, 6) + 0.0 AS top_jaccard, conflict_reason FROM cf")
def tk_08_conflicts(spark, sf_dir):
    """All pairs of passing factors with what makes them conflict."""
    decided, sections = gated(spark, sf_dir)
    c = conflicts(sections, passing(spark, decided))
    return c.select("factor_a", "factor_b", "same_family", "same_mechanism", rounded(F.col("median_abs_ic")).alias("median_abs_ic"), rounded(F.col("top_jaccard")).alias("top_jaccard"), "conflict_reason")


@query("tk_07_08_greedy_selection", f"{SQL_SELECTED} SELECT factor_id, place, status, reason FROM gy WHERE place > 0")
def tk_08(spark, sf_dir):
    """Passing factors in the fixed order, taken unless one that conflicts with them was."""
    return selected(spark, *gated(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query("tk_08_pool_messages", f"""{SQL_SELECTED}, sl AS (SELECT mechanism_tag FROM gy JOIN cat USING (factor_id) WHERE status = 'SELECTED')
SELECT count(*) AS n_selected, array_to_string(list_filter([CASE WHEN count(*) < {_P["pool_min"]} THEN 'COMPOSITE_BLOCKED_INSUFFICIENT_ALPHA' END, CASE WHEN count(*) > count(DISTINCT mechanism_tag) THEN 'SAME_MECHANISM_INCLUDED' END], lambda x: x IS NOT NULL), ',') AS messages FROM sl""")
def tk_08_messages(spark, sf_dir):
    decided = selected(spark, *gated(spark, sf_dir)).join(F.broadcast(catalogue(spark)), "factor_id")
    return sel.pool_messages(decided).select("n_selected", F.array_join("messages", ",").alias("messages"))


_SQL_STAGES = ", ".join(f"({i + 1}, '{name}', [{', '.join(repr(s) for s in taken)}]::VARCHAR[])" for i, (name, taken) in enumerate(sel.FUNNEL))


@query("ag_19_gate_funnel", f"""{SQL_SELECTED}, fs AS (SELECT cat.factor_id, coalesce(gy.status, split_part(said, '/', 1), 'CATALOG_INELIGIBLE') AS status FROM cat LEFT JOIN gt USING (factor_id) LEFT JOIN gy USING (factor_id)),
st(stage, name, gone) AS (VALUES {_SQL_STAGES}), sr AS (SELECT stage, name, (SELECT count(*) FROM fs WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.stage <= st.stage AND list_contains(b.gone, fs.status))) AS remaining FROM st)
SELECT stage, name, remaining, coalesce(lag(remaining) OVER (ORDER BY stage) - remaining, 0) AS removed FROM sr""")
def ag_19(spark, sf_dir):
    """From all versions of the catalogue to the pool."""
    gates, sections = gated(spark, sf_dir)
    final = selected(spark, gates, sections).select("factor_id", F.col("status").alias("final"))
    decided = F.broadcast(catalogue(spark)).join(gates.select("factor_id", "status"), "factor_id", "left").join(final, "factor_id", "left")
    return sel.funnel(decided.select(F.coalesce("final", "status", F.lit("CATALOG_INELIGIBLE")).alias("status"))).withColumn("stage", F.col("stage").cast("int"))


@query("tk_01_top_n", f"""WITH {SQL_EVENTS}, k AS (SELECT session, security_id, row_number() OVER (PARTITION BY session ORDER BY close DESC, security_id) AS place, count(*) OVER (PARTITION BY session) AS n FROM grid_e WHERE close IS NOT NULL)
SELECT session, security_id, place, CASE WHEN place <= 7 THEN 'BUY' ELSE 'OUT' END AS action, round(CASE WHEN place <= 7 THEN 0.95 / least(n, 7) ELSE 0 END, 9) + 0.0 AS weight FROM k""")
def tk_01(spark, sf_dir):
    g = panels.event_grid(spark, sf_dir).select("session", "security_id", F.col("close").alias("score"))
    return pf.top_n(g, 7).select("session", "security_id", F.col("place").cast("long").alias("place"), "action", rounded(F.col("weight"), 9).alias("weight"))


_SQL_CAPPED = f"""WITH {SQL_EVENTS}, a AS (SELECT session, security_id, close AS score, security_id % 4 AS sector FROM grid_e WHERE close IS NOT NULL),
b AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY session) * 0.2)) AS n FROM a),
c AS (SELECT *, least(CAST(0.06 AS DECIMAL(20,10)), CAST(0.95 / n AS DECIMAL(20,10))) AS weight FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY session, sector ORDER BY score DESC, security_id) <= floor(0.3 / weight + 1e-9) AS passes FROM c),
e AS (SELECT *, coalesce(sum(CAST(passes AS INT)) OVER (PARTITION BY session ORDER BY score DESC, security_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT session, security_id, CASE WHEN before >= n THEN 'OUTSIDE_TOP_N' WHEN NOT passes THEN 'SECTOR_CAP' END AS reason, round(CASE WHEN before >= n OR NOT passes THEN 0 ELSE CAST(weight AS DOUBLE) END, 8) + 0.0 AS weight FROM e"""


@query("tk_02_capped_top", _SQL_CAPPED)
def tk_02(spark, sf_dir):
    g = panels.event_grid(spark, sf_dir).select("session", "security_id", F.col("close").alias("score"), (F.col("security_id") % 4).alias("sector"))
    return pf.capped_top(g, 0.2, 0.05, 0.06, 0.3).select("session", "security_id", "reason", rounded(F.col("target_weight").cast("double"), 8).alias("weight"))


@query("tk_03_benchmarks", f"""WITH {SQL_EVENTS}, a AS (SELECT session, security_id, security_id % 3 AS sector, 1.0 / count(*) OVER (PARTITION BY session) AS w FROM grid_e WHERE close IS NOT NULL),
b AS (SELECT *, sum(w) OVER (PARTITION BY session, sector) AS t FROM a) SELECT session, security_id, round(w, 9) + 0.0 AS equal, round(w * least(1.0, 0.3 / t), 9) + 0.0 AS matched FROM b""")
def tk_03(spark, sf_dir):
    g = panels.event_grid(spark, sf_dir).where("close is not null").select("session", "security_id", (F.col("security_id") % 3).alias("sector"))
    return pf.benchmarks(g, 0.3).select("session", "security_id", rounded(F.col("equal"), 9).alias("equal"), rounded(F.col("matched"), 9).alias("matched"))


@query("tk_04_05_universe", """WITH a AS (SELECT s_suppkey AS security_id, count(l_orderkey) AS n, coalesce(sum(l_extendedprice), 0) AS adv, any_value(s_acctbal) AS balance FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
b AS (SELECT *, list_filter([CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END, CASE WHEN balance < 0 THEN 'LOW_BALANCE' END, CASE WHEN security_id % 11 = 0 THEN 'BLOCKED' END], lambda x: x IS NOT NULL) AS r FROM a),
c AS (SELECT *, len(r) = 0 AS eligible, count(*) FILTER (len(r) = 0) OVER () AS m FROM b), d AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY adv DESC, security_id) END AS place FROM c)
SELECT security_id, array_to_string(r, ',') AS reasons, eligible, place, coalesce(eligible AND m >= 5 AND place <= 50, false) AS selected FROM d""")
def tk_04(spark, sf_dir):
    """Eligibility with reasons, places by liquidity, gates on size."""
    s, li = panels.read(spark, sf_dir, "supplier"), panels.read(spark, sf_dir, "lineitem")
    # a sum of doubles depends on the order of its rows, which would part equal sums: decimals keep them equal, and ids decide
    adv = F.sum(F.col("l_extendedprice").try_cast("decimal(24,6)")).cast("double")
    traded = li.groupBy(F.col("l_suppkey").alias("security_id")).agg(F.count("*").alias("n"), adv.alias("adv"))
    rows = s.select(F.col("s_suppkey").alias("security_id"), "s_acctbal").join(traded, "security_id", "left").fillna(0, ["n", "adv"])
    out = sel.liquid_universe(rows, {"INSUFFICIENT_HISTORY": F.col("n") < 20, "LOW_BALANCE": F.col("s_acctbal") < 0, "BLOCKED": F.col("security_id") % 11 == 0}, "adv", 5, 50)
    return out.select("security_id", F.array_join("reasons", ",").alias("reasons"), "eligible", F.col("place").cast("long").alias("place"), F.coalesce("selected", F.lit(False)).alias("selected"))


def _nav(spark, sf_dir) -> DataFrame:
    days = panels.read(spark, sf_dir, "events").select(F.to_date("ts").alias("session"))
    return pf.cohort_nav(panels.event_grid(spark, sf_dir), _weights(spark, sf_dir), sessions=days)


def _weights(spark, sf_dir) -> DataFrame:
    top = dg.with_top(scores(spark, sf_dir).where("factor_id = 'reversal'"), ["factor_id"]).where("__top")
    rows = top.join(F.broadcast(signals(spark, sf_dir)), "session")
    return rows.select("execution", "security_id", (0.95 / F.count("*").over(Window.partitionBy("execution"))).alias("weight"))


_SQL_WEIGHTS = f"{SQL_BASE}, {SQL_TOP}, w AS (SELECT execution, security_id, 0.95 / count(*) OVER (PARTITION BY execution) AS weight FROM top JOIN sig USING (session) WHERE factor_id = 'reversal')"


@query("tk_12_target_weights", f"{_SQL_WEIGHTS} SELECT execution, security_id, round(weight, 9) + 0.0 AS weight FROM w")
def tk_12(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("weight", rounded(F.col("weight"), 9))


_SQL_NAV = f"""{_SQL_WEIGHTS}, x AS (SELECT execution, lead(execution) OVER (ORDER BY execution) AS until FROM (SELECT DISTINCT execution FROM w)),
pr AS (SELECT session, security_id, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS price FROM grid_e),
h AS (SELECT w.execution, until, w.security_id, weight, session AS dy, weight * coalesce(price / first_value(price IGNORE NULLS) OVER (PARTITION BY w.execution, w.security_id ORDER BY session ROWS UNBOUNDED PRECEDING), 1.0) AS v
  FROM w JOIN x USING (execution) JOIN pr ON pr.security_id = w.security_id WHERE session >= w.execution AND (until IS NULL OR session <= until)),
o AS (SELECT execution, dy, sum(v) + 1 - sum(weight) AS worth FROM h GROUP BY 1, 2), r AS (SELECT dy AS session, g FROM (SELECT dy, worth / lag(worth) OVER (PARTITION BY execution ORDER BY dy) - 1 AS g FROM o) WHERE g IS NOT NULL),
dr AS (SELECT until AS execution, h.security_id, v / worth AS was FROM h JOIN o ON o.execution = h.execution AND o.dy = h.dy WHERE h.dy = until),
tn AS (SELECT coalesce(w.execution, dr.execution) AS session, sum(abs(coalesce(weight, 0) - coalesce(was, 0))) AS t FROM w FULL JOIN dr ON w.execution = dr.execution AND w.security_id = dr.security_id GROUP BY 1),
z AS (SELECT coalesce(r.session, tn.session) AS session, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM r FULL JOIN tn ON r.session = tn.session),
nav AS (SELECT session, g, t, product((1 + g) * (1 - 0.001 * t)) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS nav FROM z)"""


@query("bt_01_cohort_nav", f"{_SQL_NAV} SELECT session, round(g, 6) + 0.0 AS gross_return, round(t, 6) + 0.0 AS turnover, round(nav, 6) + 0.0 AS nav FROM nav")
def bt_01(spark, sf_dir):
    out = _nav(spark, sf_dir)
    return out.select("session", *(rounded(F.col(c)).alias(c) for c in ("gross_return", "turnover", "nav")))


@query("ag_21_nav_metrics", f"""{_SQL_NAV}, m AS (SELECT *, coalesce(nav / lag(nav) OVER (ORDER BY session) - 1, 0) AS ret, nav / max(nav) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM nav)
SELECT round(last(nav ORDER BY session) / first(nav ORDER BY session) - 1, 6) + 0.0 AS total_return, round(stddev_samp(ret) * sqrt(252), 6) + 0.0 AS volatility, round(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0), 6) + 0.0 AS sharpe, round(min(fall), 6) + 0.0 AS max_drawdown FROM m""")
def ag_21(spark, sf_dir):
    nav = _nav(spark, sf_dir).withColumn("pool", F.lit(1))
    out = dg.nav_metrics(nav, ["pool"])
    return out.select(*(rounded(F.col(c)).alias(c) for c in ("total_return", "volatility", "sharpe", "max_drawdown")))


@query("bt_02_03_two_periods", f"""{SQL_BASE}, {SQL_IC}, h AS (SELECT factor_id, CASE WHEN session < DATE '2024-01-15' THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS period, ic FROM ic)
SELECT factor_id, period, round(avg(ic), 6) + 0.0 AS mean_ic, count(ic) AS n_sessions FROM h GROUP BY 1, 2""")
def bt_02(spark, sf_dir):
    """A frozen pool on two windows of dates."""
    period = F.when(F.col("session") < F.lit("2024-01-15").cast("date"), "DEVELOPMENT").otherwise("HOLDOUT")
    ics = dg.rank_ic(pairs(spark, sf_dir), ["factor_id", "session"]).withColumn("period", period)
    return dg.ic_summary(ics, ["factor_id", "period"]).select("factor_id", "period", rounded(F.col("mean_ic")).alias("mean_ic"), "n_sessions")


@query("ag_23_universe_index", f"""WITH {SQL_EVENTS}, c0 AS (SELECT session, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM grid_e), c AS (SELECT session, CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.5), 0.5) END AS r FROM c0), m AS (SELECT session, avg(r) AS r FROM c GROUP BY 1)
SELECT session, round(product(1 + coalesce(r, 0)) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS index FROM m""")
def ag_23(spark, sf_dir):
    g = panels.event_grid(spark, sf_dir).withColumn("r", ts.ts_change(F.col("close")))
    clipped = F.when(F.col("r").isNotNull(), F.least(F.greatest("r", F.lit(-0.5)), F.lit(0.5)))
    m = g.select("session", clipped.alias("r")).groupBy("session").agg(F.avg("r").alias("r"))
    return m.select("session", rounded(F.product(1 + F.coalesce("r", F.lit(0.0))).over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0))).alias("index"))


@query("dq_09_prefix_invariance")
def dq_09(spark, sf_dir):
    """Rows of any factor that change when the future is cut off or altered; none should."""
    from tidepanel.operators.quality import prefix_invariant

    panel = panels.event_grid(spark, sf_dir)
    return prefix_invariant(panel, lambda p: evaluate(p, FACTORS), F.lit("2024-01-20").cast("date"))


@query("dq_10_neutrality", f"WITH {SQL_EVENTS} SELECT 'NEUTRALIZED' AS check, 0::BIGINT AS failed_rows UNION ALL SELECT 'RAW', count(*) FILTER (abs(m) > 1e-9) FROM (SELECT avg(close) AS m FROM grid_e WHERE close IS NOT NULL GROUP BY session, security_id % 3)")
def dq_10(spark, sf_dir):
    """Group means are zero after neutralisation, and not before."""
    from tidepanel.operators.quality import neutral_check

    g = panels.event_grid(spark, sf_dir).withColumn("g", F.col("security_id") % 3)
    done = neutral_check(g.withColumn("v", cs.group_neutralize(F.col("close"), F.col("g"))), "v", ["session", "g"]).withColumn("check", F.lit("NEUTRALIZED"))
    return done.unionByName(neutral_check(g, "close", ["session", "g"]).withColumn("check", F.lit("RAW")))
