"""Trailing, cross-section and scalar operators on the weekly supplier grid and the daily user grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions import scalar as sc
from tidepanel.functions import timeseries as ts
from tidepanel.plans.registry import add, query, rounded
from tidepanel.sources import panels
from tidepanel.sources.panels import SQL_EVENTS, SQL_LABELS, SQL_SUPPLIERS



class _Fields:
    """Columns of the panel by name, made when a session is there."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


C = _Fields()
N = 4
W = "PARTITION BY security_id ORDER BY session"
FRAME = f"({W} ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"


def _full(e: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {FRAME} = {N} THEN {e} END"


def _trailing(name: str, value: Callable[[], Column], sql: str, steps: dict[str, Callable[[], Column]] | None = None, sql_steps: str = "grid_l") -> None:
    """Registers an operator over the weekly grid; ``steps`` are columns that it needs first."""

    def run(spark, sf_dir):
        grid = panels.supplier_grid(spark, sf_dir)
        for k, v in (steps or {}).items():
            grid = grid.withColumn(k, v())
        return grid.select("session", "security_id", rounded(value()).alias("value"))

    add(name, run, f"WITH {SQL_SUPPLIERS} SELECT session, security_id, round({sql}, 6) + 0.0 AS value FROM {sql_steps}")


_CHANGE = {"change": lambda: ts.ts_change(C.close)}
_SQL_CHANGE = f"(SELECT *, close / lag(close) OVER ({W}) - 1 AS change FROM grid_l)"
_trailing("ts_01_delay", lambda: ts.ts_delay(C.close, N), f"lag(close, {N}) OVER ({W})")
_trailing("ts_02_delta", lambda: ts.ts_delta(C.close, 2), f"close - lag(close, 2) OVER ({W})")
_trailing("ts_03_mean", lambda: ts.ts_mean(C.close, N), _full(f"avg(close) OVER {FRAME}"))
_trailing("ts_04_std_dev", lambda: ts.ts_std_dev(C.close, N), _full(f"stddev_pop(close) OVER {FRAME}"))
_trailing("ts_05_sum", lambda: ts.ts_sum(C.volume, N), _full(f"sum(volume) OVER {FRAME}", "volume"))
_PAIRS = "(SELECT *, CASE WHEN volume IS NOT NULL THEN close END AS a, CASE WHEN close IS NOT NULL THEN volume END AS b FROM grid_l)"
_trailing("ts_06_corr", lambda: ts.ts_corr(C.close, C.volume, N), _full(f"CASE WHEN stddev_pop(a) OVER {FRAME} * stddev_pop(b) OVER {FRAME} > 1e-12 THEN covar_pop(a, b) OVER {FRAME} / (stddev_pop(a) OVER {FRAME} * stddev_pop(b) OVER {FRAME}) END", "a"), sql_steps=_PAIRS)
_trailing("ts_07_covariance", lambda: ts.ts_covariance(C.close, C.volume, N), _full(f"covar_pop(a, b) OVER {FRAME}", "a"), sql_steps=_PAIRS)
_LIST = f"(SELECT *, list(close) FILTER (close IS NOT NULL) OVER {FRAME} AS held FROM grid_l)"
_trailing("ts_08_arg_min", lambda: ts.ts_arg_min(C.close, N).cast("double"), _full(f"({N} - list_position(held, list_min(held)))::DOUBLE"), sql_steps=_LIST)
_trailing("ts_09_arg_max", lambda: ts.ts_arg_max(C.close, N).cast("double"), _full(f"({N} - list_position(held, list_max(held)))::DOUBLE"), sql_steps=_LIST)
_trailing("ts_10_scale", lambda: ts.ts_scale(C.close, N), _full(f"(close - min(close) OVER {FRAME}) / nullif(max(close) OVER {FRAME} - min(close) OVER {FRAME}, 0)"))
_trailing("ts_11_rank", lambda: ts.ts_rank(C.close, N), _full(f"(len(list_filter(held, lambda v: v < close)) + (len(list_filter(held, lambda v: v = close)) + 1) / 2.0) / {N}"), sql_steps=_LIST)
_trailing("ts_13_linear_decay", lambda: ts.linear_decay(C.close, N), f"({N} * close + " + " + ".join(f"{N - k} * lag(close, {k}) OVER ({W})" for k in range(1, N)) + f") / {N * (N + 1) / 2}")
_trailing("ts_13_linear_decay_long", lambda: ts.linear_decay(F.col("filled"), 12), f"CASE WHEN count(filled) OVER ({W} ROWS 11 PRECEDING) = 12 THEN (12 * filled + " + " + ".join(f"{12 - k} * lag(filled, {k}) OVER ({W})" for k in range(1, 12)) + ") / 78.0 END",
    {"filled": lambda: ts.forward_fill(C.close)}, f"(SELECT *, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS filled FROM grid_l)")
_trailing("ts_14_input_delay", lambda: ts.ts_mean(F.col("late"), N), _full(f"avg(late) OVER {FRAME}", "late"), {"late": lambda: ts.ts_delay(C.close, 1)}, f"(SELECT *, lag(close) OVER ({W}) AS late FROM grid_l)")
_trailing("ts_15_forward_fill", lambda: ts.forward_fill(C.close, 1.0), f"coalesce(last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 1.0)")
_trailing("ts_16_change", lambda: ts.ts_change(C.close), f"close / lag(close) OVER ({W}) - 1")
_trailing("ts_17_smoothed_mean", lambda: ts.mean_of_at_least(C.close, 13, 5), f"CASE WHEN count(close) OVER ({W} ROWS 12 PRECEDING) >= 5 THEN avg(close) OVER ({W} ROWS 12 PRECEDING) END")
_trailing("ts_18_drawdown", lambda: ts.drawdown(F.col("filled")), f"filled / max(filled) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1", {"filled": lambda: ts.forward_fill(C.close, 1.0)},
    f"(SELECT *, coalesce(last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 1.0) AS filled FROM grid_l)")
_trailing("ts_18_growth", lambda: ts.growth(F.col("small")), f"product(1 + coalesce(small, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING)", {"small": lambda: (C.close - C.open) / (C.close + C.open) / 10}, "(SELECT *, (close - open) / (close + open) / 10 AS small FROM grid_l)")
_trailing("ts_zscore", lambda: ts.ts_zscore(C.close, N), _full(f"(close - avg(close) OVER {FRAME}) / nullif(stddev_pop(close) OVER {FRAME}, 0)"))
_trailing("sc_09_volatility", lambda: ts.volatility(C.close, F.col("change"), N), _full(f"stddev_pop(change) OVER {FRAME} * sqrt(252)", "change"), _CHANGE, _SQL_CHANGE)
_LAST = {"last": lambda: ts.ts_delay(C.close, 1), "range": lambda: sc.true_range(C.high, C.low, F.col("last"))}
_SQL_LAST = f"(SELECT *, CASE WHEN last IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - last), abs(low - last)) END AS range FROM (SELECT *, lag(close) OVER ({W}) AS last FROM grid_l))"
_trailing("sc_10_atr", lambda: ts.atr(F.col("range"), N), _full(f"avg(range) OVER {FRAME}", "range"), _LAST, _SQL_LAST)
_trailing("sc_15_typical_price", lambda: sc.typical_price(C.high, C.low, C.close), "(high + low + close) / 3")


@query("ts_12_days_from_change", f"""WITH {SQL_EVENTS}, b AS (SELECT session, security_id, CASE WHEN close IS NOT NULL THEN CAST(floor(close / 20) AS BIGINT) END AS x FROM grid_e),
f AS (SELECT *, CASE WHEN x IS NULL OR lag(x) OVER w IS NULL OR x <> lag(x) OVER w THEN 1 ELSE 0 END AS flag FROM b WINDOW w AS ({W})),
i AS (SELECT *, sum(flag) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT session, security_id, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY security_id, island ORDER BY session) - 1 END AS value FROM i""")
def ts_12(spark, sf_dir):
    """Sessions since the value changed; a missing value has none and begins anew."""
    g = panels.event_grid(spark, sf_dir).select("session", "security_id", F.floor(C.close / 20).alias("x"))
    g = g.withColumn("flag", ts.change_flag(F.col("x"))).withColumn("island", F.sum("flag").over(ts.running()))
    place = F.row_number().over(cs.across("security_id", "island").orderBy("session"))
    return g.select("session", "security_id", F.when(F.col("x").isNotNull(), place - 1).cast("long").alias("value"))


MARKET = 1


@query("sc_11_14_market_risk", f"""WITH {SQL_EVENTS}, r AS (SELECT session, security_id, close / nullif(lag(close) OVER ({W}), 0) - 1 AS change FROM grid_e),
m AS (SELECT r.session, r.security_id, r.change AS x, b.change AS y FROM r JOIN r b ON b.session = r.session AND b.security_id = {MARKET} WHERE r.security_id <> {MARKET}),
p AS (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS a, CASE WHEN x IS NOT NULL THEN y END AS b FROM m),
s AS (SELECT *, {_full(f"covar_pop(a, b) OVER {FRAME} / nullif(var_pop(b) OVER {FRAME}, 0)", "a")} AS beta,
  {_full(f"CASE WHEN stddev_pop(a) OVER {FRAME} * stddev_pop(b) OVER {FRAME} > 1e-12 THEN covar_pop(a, b) OVER {FRAME} / (stddev_pop(a) OVER {FRAME} * stddev_pop(b) OVER {FRAME}) END", "a")} AS corr,
  {_full(f"stddev_pop(y) OVER {FRAME}", "y")} AS market_dev FROM p),
t AS (SELECT *, x - beta * y AS residual FROM s)
SELECT session, security_id, round(beta, 5) + 0.0 AS beta, round(corr, 5) + 0.0 AS corr, round(abs(beta) * market_dev, 5) + 0.0 AS systematic,
  round({_full(f"stddev_pop(residual) OVER {FRAME}", "residual")}, 5) + 0.0 AS residual_risk FROM t""")
def sc_11_14(spark, sf_dir):
    """Beta, correlation, systematic and residual risk against one security's changes, which every other one takes by session."""
    g = panels.event_grid(spark, sf_dir).withColumn("x", F.try_divide(C.close, ts.ts_delay(C.close, 1)) - 1)
    market = g.where(F.col("security_id") == MARKET).select("session", F.col("x").alias("y"))
    g = g.where(F.col("security_id") != MARKET).join(market, "session")
    x, y = F.col("x"), F.col("y")
    g = g.withColumns({"beta": F.try_divide(ts.ts_covariance(x, y, N), ts.ts_covariance(y, F.when(x.isNotNull(), y), N)), "corr": ts.ts_corr(x, y, N), "dev": ts.ts_std_dev(y, N)})
    g = g.withColumn("residual", x - F.col("beta") * y)
    return g.select("session", "security_id", rounded(F.col("beta"), 5).alias("beta"), rounded(F.col("corr"), 5).alias("corr"),
        rounded(F.abs("beta") * F.col("dev"), 5).alias("systematic"), rounded(ts.ts_std_dev(F.col("residual"), N), 5).alias("residual_risk"))


def _across(name: str, value: Callable[[], Column], sql: str, sql_from: str = "grid_e", before=None) -> None:
    def run(spark, sf_dir) -> DataFrame:
        g = panels.event_grid(spark, sf_dir)
        return (before(g) if before else g).select("session", "security_id", value().alias("value"))

    add(name, run, f"WITH {SQL_EVENTS} SELECT session, security_id, {sql} AS value FROM {sql_from}")


_SHARE = "(rank() OVER (PARTITION BY session, close IS NULL ORDER BY close) + (count(*) OVER (PARTITION BY session, close) - 1) / 2.0) / count(close) OVER (PARTITION BY session)"
_RANKED = f"(SELECT *, CASE WHEN close IS NOT NULL THEN {_SHARE} END AS share FROM grid_e)"
def _group() -> Column:
    return F.when(F.col("security_id") % 5 != 0, F.col("security_id") % 3)


_GROUPED = "(SELECT *, CASE WHEN security_id % 5 <> 0 THEN security_id % 3 END AS g FROM grid_e)"
_across("cs_01_rank", lambda: rounded(cs.rank(C.close)), "round(share, 6) + 0.0", _RANKED)
_across("cs_02_group_rank", lambda: rounded(cs.group_rank(C.close, _group())), f"round(CASE WHEN g IS NOT NULL AND close IS NOT NULL THEN {_SHARE.replace('PARTITION BY session', 'PARTITION BY session, g')} END, 6) + 0.0", _GROUPED)
_across("cs_03_group_neutralize", lambda: rounded(cs.group_neutralize(C.close, _group()), 9), "round(CASE WHEN g IS NOT NULL THEN close - avg(close) OVER (PARTITION BY session, g) END, 9) + 0.0", _GROUPED)
_across("cs_07_oriented", lambda: rounded(cs.oriented(F.col("share"), F.when(F.col("security_id") % 2 == 0, 1).otherwise(-1))), "round(CASE WHEN security_id % 2 = 0 THEN share ELSE 1 - share END, 6) + 0.0", _RANKED, lambda g: g.withColumn("share", cs.rank(C.close)))
_across("cs_08_bucket", lambda: cs.bucket(F.round(F.col("share"), 9), 5).cast("long"), "CAST(least(greatest(ceil(round(share, 9) * 5), 1), 5) AS BIGINT)", f"(SELECT * FROM {_RANKED} WHERE share IS NOT NULL)", lambda g: g.withColumn("share", cs.rank(C.close)).where("share is not null"))
_across("cs_09_positional_deciles", lambda: cs.positional_deciles(C.close, F.col("security_id"), 10).cast("long"), "CASE WHEN close IS NOT NULL THEN ntile(10) OVER (PARTITION BY session, close IS NULL ORDER BY close, security_id) END")
_across("cs_10_integer_deciles", lambda: cs.integer_deciles(C.close, F.col("security_id"), 10).cast("long"), "CASE WHEN close IS NOT NULL THEN least(10, (row_number() OVER (PARTITION BY session, close IS NULL ORDER BY close, security_id) - 1) * 10 // count(close) OVER (PARTITION BY session) + 1) END")
_across("cs_12_top_share", lambda: cs.in_top(C.close, F.col("security_id"), 0.1), "close IS NOT NULL AND row_number() OVER (PARTITION BY session ORDER BY close DESC NULLS LAST, security_id) <= greatest(1, ceil(round(count(close) OVER (PARTITION BY session) * 0.1, 9)))")


@query("cs_04_05_neutralized_factor", f"""WITH {SQL_SUPPLIERS}, {SQL_LABELS}, l AS (
  SELECT g.session, g.security_id, arg_max(sector, (effective_at, l.available_at)) AS sector FROM grid_l g LEFT JOIN labels_l l ON l.security_id = g.security_id AND greatest(effective_at, l.available_at) <= g.session GROUP BY 1, 2),
d AS (SELECT *, lag(close, 1) OVER ({W}) AS c1, lag(open, 1) OVER ({W}) AS o1 FROM grid_l),
f AS (SELECT session, security_id, -(c1 / o1 - 1) AS raw FROM d),
k AS (SELECT session, security_id, (2 * raw + lag(raw) OVER ({W})) / 3 AS x FROM f)
SELECT k.session, k.security_id, round(CASE WHEN sector IS NOT NULL THEN x - avg(x) OVER (PARTITION BY k.session, sector) END, 6) + 0.0 AS value
FROM k JOIN l ON l.session = k.session AND l.security_id = k.security_id""")
def cs_04_05(spark, sf_dir):
    """Inputs delayed, formula, decay, then group-neutral with labels known at the session."""
    from tidepanel.operators.factor import Factor, col, evaluate

    grid = panels.supplier_grid(spark, sf_dir)
    factor = Factor("reversal", -(col("close") / col("open") - 1), delay=1, decay=2, neutralization="sector")
    out = evaluate(grid, [factor], panels.labels(spark, sf_dir))
    return out.select("session", "security_id", rounded(F.col("reversal")).alias("value"))


@query("cs_06_composite", f"""WITH {SQL_EVENTS}, r AS (SELECT session, security_id, close, volume, {_SHARE} AS a, {_SHARE.replace('close', 'volume')} AS b FROM grid_e)
SELECT session, security_id, round((a + (1 - b)) / 2, 6) + 0.0 AS value FROM r WHERE close IS NOT NULL AND volume IS NOT NULL""")
def cs_06(spark, sf_dir):
    """Mean of oriented ranks where all factors are there."""
    from tidepanel.operators.selection import composite

    g = panels.event_grid(spark, sf_dir)
    r = g.select("session", "security_id", cs.rank(C.close).alias("close"), (1 - cs.rank(C.volume)).alias("volume"))
    long = r.unpivot(["session", "security_id"], ["close", "volume"], "factor_id", "share")
    return composite(long, 2).select("session", "security_id", rounded(F.col("score")).alias("value"))


@query("cs_11_edges", f"""WITH {SQL_EVENTS}, e AS (SELECT session, quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) AS q FROM grid_e WHERE close IS NOT NULL GROUP BY 1)
SELECT g.session, g.security_id, CAST(1 + len(list_filter(q, lambda v: close > v)) AS BIGINT) AS value FROM grid_e g JOIN e USING (session) WHERE close IS NOT NULL""")
def cs_11(spark, sf_dir):
    """Buckets between quantile edges, closed on the right."""
    g = panels.event_grid(spark, sf_dir).where("close is not null")
    edges = g.groupBy("session").agg(F.percentile("close", F.array(*(F.lit(i / 5) for i in range(1, 5)))).alias("edges"))
    return g.join(edges, "session").select("session", "security_id", (1 + F.size(F.filter("edges", lambda v: F.col("close") > v))).cast("long").alias("value"))


@query("sc_01_08_arithmetic", f"""WITH {SQL_EVENTS} SELECT session, security_id, round(close / nullif(open - low, 0), 6) + 0.0 AS quotient, coalesce(close > open, false) AS above,
  coalesce(close <> open, true) AS differs, CASE WHEN close > open THEN 'up' ELSE 'other' END AS branch, round(abs(close - open), 6) + 0.0 AS distance, CAST(sign(close - open) AS DOUBLE) + 0.0 AS direction,
  round(CASE WHEN close > 0 THEN ln(close) END, 6) + 0.0 AS logarithm, greatest(close, open) AS larger, round(CASE WHEN abs(close) < 1e9 THEN pow(abs(close), 0.5) END, 6) + 0.0 AS root, close IS NOT NULL AS finite FROM grid_e""")
def sc_01_08(spark, sf_dir):
    g = panels.event_grid(spark, sf_dir)
    return g.select("session", "security_id", rounded(sc.divide(C.close, C.open - C.low)).alias("quotient"), sc.greater(C.close, C.open).alias("above"), sc.unequal(C.close, C.open).alias("differs"),
        sc.if_else(C.close > C.open, F.lit("up"), F.lit("other")).alias("branch"), rounded(F.abs(C.close - C.open)).alias("distance"), (F.signum(C.close - C.open) + 0.0).alias("direction"),
        rounded(sc.log(C.close)).alias("logarithm"), sc.larger(C.close, C.open).alias("larger"), rounded(sc.power(F.abs(C.close), F.lit(0.5))).alias("root"), sc.is_finite(C.close).alias("finite"))


@query("sc_16_26_text_and_time", """SELECT s_suppkey, replace(upper(trim(s_name)), '-', '.') AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS padded, lower(replace(trim(' USD / Share '), ' ', '')) AS unit,
  CASE WHEN s_suppkey % 4 = 0 THEN 'ETF' WHEN s_suppkey % 4 = 1 THEN 'ADR' ELSE 'COMMON_STOCK' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'B' END AS suffix,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'Mining' END AS label, TIMESTAMP '2024-03-01 21:05:00' AS accepted, 366 AS days, 202409 AS week, false AS hashed FROM supplier""")
def sc_16_26(spark, sf_dir):
    s, key = panels.read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.when(key % 4 == 0, "Wide Index ETF").when(key % 4 == 1, "Some Depositary Shares").otherwise("Plain Inc")
    ticker = F.when(key % 2 == 0, "BRK-B").otherwise("AAPL")
    stamp = F.when(key % 2 == 0, "20240301210500").otherwise("2024-03-01T21:05:00Z")
    return s.select("s_suppkey", sc.dotted_ticker(F.col("s_name")).alias("ticker"), sc.padded_id(key).alias("padded"), sc.plain_unit(F.lit(" USD / Share ")).alias("unit"),
        sc.security_type(name, {"ETF": r"\bETF\b", "ADR": "Depositary"}).alias("kind"), sc.class_suffix(ticker).alias("suffix"), sc.clean_label(F.when(key % 3 == 0, " NaN ").otherwise(" Mining ")).alias("label"),
        sc.acceptance(stamp).cast("timestamp_ntz").alias("accepted"), sc.days_inclusive(F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date")).alias("days"), sc.iso_week(F.lit("2024-03-01").cast("date")).cast("int").alias("week"), sc.is_hash(F.col("s_name")).alias("hashed"))
