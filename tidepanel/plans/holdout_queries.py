"""A pool frozen on a development period and judged on both periods: composites, all diagnostics, net values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.operators import diagnostics as dg
from tidepanel.operators import portfolio as pf
from tidepanel.operators import selection as sel
from tidepanel.plans.factor_queries import SQL_DIAGNOSED, SQL_WEEKLY_PAIRS, weekly_scores
from tidepanel.plans.registry import query, rounded
from tidepanel.sources import panels
from tidepanel.sources.shared import written

_SPLIT, POOLS = "1996-01-01", {"ALL": ("level_4", "momentum", "calm", "activity", "reversal"), "TWO": ("momentum", "reversal")}
_POOL = ", ".join(f"'{f}'" for f in POOLS["ALL"])
#: Composites of both pools on both periods, in the place of factors.
_SQL_COMPOSITES = f"""{SQL_WEEKLY_PAIRS}, fp AS (SELECT * FROM p WHERE factor_id IN ({_POOL})),
fi AS (SELECT factor_id, session, rank() OVER (PARTITION BY factor_id, session ORDER BY score) + (count(*) OVER (PARTITION BY factor_id, session, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY factor_id, session ORDER BY forward_return) + (count(*) OVER (PARTITION BY factor_id, session, forward_return) - 1) / 2.0 AS y FROM fp WHERE score IS NOT NULL AND forward_return IS NOT NULL AND session < DATE '{_SPLIT}'),
fd AS (SELECT factor_id, CASE WHEN coalesce(avg(ic), 0) >= 0 THEN 1 ELSE -1 END AS direction FROM (SELECT factor_id, session, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM fi GROUP BY 1, 2) GROUP BY 1),
sh AS (SELECT fp.*, CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY fp.factor_id, session, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY fp.factor_id, session, score) - 1) / 2.0) / count(score) OVER (PARTITION BY fp.factor_id, session) END AS share FROM fp),
so AS (SELECT sh.*, CASE WHEN direction = 1 THEN share ELSE 1 - share END AS o FROM sh JOIN fd USING (factor_id)),
cm AS ({" UNION ALL ".join(f"SELECT '{name}' AS composite_id, session, ordinal, security_id, any_value(forward_return) AS forward_return, CASE WHEN count(o) = {len(pool)} THEN round(avg(o), 9) END AS score FROM so WHERE factor_id IN ({', '.join(repr(f) for f in pool)}) GROUP BY 2, 3, 4" for name, pool in POOLS.items())}),
cp AS (SELECT composite_id || '|' || CASE WHEN session < DATE '{_SPLIT}' THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS factor_id, session, ordinal, security_id, forward_return, score FROM cm)"""


def pool_shares(spark, sf_dir):
    """A row for each week and security, written once: close, forward_return, rank shares of the pool's factors, and the week's
    correlations."""
    factors = list(POOLS["ALL"])
    wide = weekly_scores(spark, sf_dir, POOLS["ALL"], keep=("close",))
    return written(dg.rank_shares(wide, factors, panels.tasks(panels.read(spark, sf_dir, "lineitem"))), "pool-shares")


def composite_pairs(spark, sf_dir, shares):
    """Rows (composite_id, period, session, security_id, score, forward_return), directions frozen on the development period."""
    signals = dg.signal_sessions(panels.supplier_sessions(spark, sf_dir)).select("session")
    at = shares.join(F.broadcast(signals), "session")
    early = F.col("session") < F.lit(_SPLIT).cast("date")
    told = [F.struct(F.lit(f).alias("factor_id"), F.col(f"ic_{f}").alias("ic"), F.col(f"n_{f}").alias("n")) for f in POOLS["ALL"]]
    one = at.where(early).groupBy("session").agg(F.first(F.array(*told)).alias("all"))
    ics = one.select("session", F.inline("all")).where("n > 0")
    found = sel.wide_composites(at.select("session", "security_id", "forward_return", *POOLS["ALL"]), POOLS, sel.frozen_directions(ics))
    return found.withColumn("score", F.round("score", 9)).withColumn("period", F.when(early, "DEVELOPMENT").otherwise("HOLDOUT"))


_METRICS = ("median_coverage", "mean_ic", "icir", "positive_year_ratio", "q1_mean", "q5_mean", "turnover", "spread")
# the diagnostics of factors, over composites
_SQL_JUDGED = _SQL_COMPOSITES + ", " + SQL_DIAGNOSED.removeprefix(SQL_WEEKLY_PAIRS + ", ").replace(" FROM p ", " FROM cp ").replace(" FROM p)", " FROM cp)").replace("WHERE a.ordinal < (SELECT max(ordinal) FROM sig)", "WHERE a.ordinal < (SELECT max(ordinal) FROM cp z WHERE z.factor_id = a.factor_id)")


@query("bt_02_03_holdout_replay", f"""{_SQL_JUDGED} SELECT split_part(factor_id, '|', 1) AS composite_id, split_part(factor_id, '|', 2) AS period, n_sessions, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _METRICS)} FROM dx""")
def bt_02(spark, sf_dir):
    """All diagnostics of two composites on both periods, keyed together in one pass."""
    pairs = composite_pairs(spark, sf_dir, pool_shares(spark, sf_dir)).withColumn("factor_id", F.concat_ws("|", "composite_id", "period"))
    out = dg.diagnose(pairs.select("factor_id", "session", "security_id", "score", "forward_return"), benchmark=panels.BENCHMARK)
    key = F.split("factor_id", r"\|")
    return out.select(F.get(key, 0).alias("composite_id"), F.get(key, 1).alias("period"), "n_sessions", *(rounded(F.col(c)).alias(c) for c in _METRICS))


def portfolio_weights(spark, sf_dir, shares):
    """Weekly targets of each composite and period, with names outside the top at 0."""
    by = ("composite_id", "period")
    signals = dg.signal_sessions(panels.supplier_sessions(spark, sf_dir))
    scored = composite_pairs(spark, sf_dir, shares).select(*by, "session", "security_id", "score").where("score is not null")
    return pf.decile_weights(scored.repartition(panels.tasks(panels.read(spark, sf_dir, "lineitem")), *by, "session"), signals, by)


_SQL_TARGETS = _SQL_COMPOSITES + """, se AS (SELECT session, lead(session) OVER (ORDER BY session) AS execution FROM (SELECT DISTINCT session FROM bars_l)),
wk AS (SELECT factor_id, execution, security_id, CASE WHEN k <= greatest(1, ceil(round(n * 0.1, 9))) THEN 0.95 / greatest(1, ceil(round(n * 0.1, 9))) ELSE 0 END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, session ORDER BY score DESC, security_id) AS k, count(*) OVER (PARTITION BY factor_id, session) AS n FROM cp WHERE score IS NOT NULL) JOIN se USING (session) WHERE execution IS NOT NULL)"""


@query("tk_12_decile_targets", f"{_SQL_TARGETS} SELECT split_part(factor_id, '|', 1) AS composite_id, split_part(factor_id, '|', 2) AS period, execution, security_id, round(weight, 9)::DOUBLE + 0.0 AS weight FROM wk")
def tk_12(spark, sf_dir):
    return portfolio_weights(spark, sf_dir, pool_shares(spark, sf_dir)).select("composite_id", "period", "execution", "security_id", rounded(F.col("weight"), 9).alias("weight"))


_SQL_NAV = _SQL_TARGETS + f""", w AS (SELECT * FROM wk WHERE weight <> 0), x AS (SELECT factor_id, execution, lead(execution) OVER (PARTITION BY factor_id ORDER BY execution) AS until FROM (SELECT DISTINCT factor_id, execution FROM w)),
h AS (SELECT w.factor_id, w.execution, until, w.security_id, weight, g.session AS dy, weight * coalesce(g.close / first_value(g.close IGNORE NULLS) OVER (PARTITION BY w.factor_id, w.execution, w.security_id ORDER BY g.session ROWS UNBOUNDED PRECEDING), 1.0) AS v
  FROM w JOIN x ON x.factor_id = w.factor_id AND x.execution = w.execution JOIN week_l g ON g.security_id = w.security_id AND g.session >= w.execution AND (until IS NULL OR g.session <= until)),
o AS (SELECT factor_id, execution, dy, sum(v) + 1 - sum(weight) AS worth FROM h GROUP BY 1, 2, 3), r AS (SELECT factor_id, dy AS session, g FROM (SELECT factor_id, dy, worth / lag(worth) OVER (PARTITION BY factor_id, execution ORDER BY dy) - 1 AS g FROM o) WHERE g IS NOT NULL),
dr AS (SELECT h.factor_id, until AS execution, h.security_id, v / worth AS was FROM h JOIN o ON o.factor_id = h.factor_id AND o.execution = h.execution AND o.dy = h.dy WHERE h.dy = until),
tv AS (SELECT coalesce(w.factor_id, dr.factor_id) AS factor_id, coalesce(w.execution, dr.execution) AS session, sum(abs(coalesce(weight, 0) - coalesce(was, 0))) AS t FROM w FULL JOIN dr ON w.factor_id = dr.factor_id AND w.execution = dr.execution AND w.security_id = dr.security_id GROUP BY 1, 2),
z AS (SELECT coalesce(r.factor_id, tv.factor_id) AS factor_id, coalesce(r.session, tv.session) AS session, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM r FULL JOIN tv ON r.factor_id = tv.factor_id AND r.session = tv.session),
nav AS (SELECT factor_id, session, product((1 + g) * (1 - 0.001 * t)) OVER (PARTITION BY factor_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS nav FROM z WHERE factor_id LIKE '%HOLDOUT' OR session < DATE '{_SPLIT}'),
m AS (SELECT *, coalesce(nav / lag(nav) OVER (PARTITION BY factor_id ORDER BY session) - 1, 0) AS ret, nav / max(nav) OVER (PARTITION BY factor_id ORDER BY session ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM nav)"""


@query("ag_20_21_portfolio_metrics", f"""{_SQL_NAV} SELECT split_part(factor_id, '|', 1) AS composite_id, split_part(factor_id, '|', 2) AS period, round(last(nav ORDER BY session) / first(nav ORDER BY session) - 1, 6) + 0.0 AS total_return,
  round(pow(last(nav ORDER BY session) / first(nav ORDER BY session), 252.0 / count(*)) - 1, 6) + 0.0 AS cagr, round(stddev_samp(ret) * sqrt(252), 6) + 0.0 AS volatility, round(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0), 6) + 0.0 AS sharpe, round(min(fall), 6) + 0.0 AS max_drawdown FROM m GROUP BY factor_id""")
def ag_20(spark, sf_dir):
    """Net values of two composites on two periods, all four portfolios in one plan, with all their metrics."""
    by = ("composite_id", "period")
    shares = pool_shares(spark, sf_dir)
    weights = written(portfolio_weights(spark, sf_dir, shares).where("weight != 0"), "targets")
    nav = pf.cohort_nav(shares.select("session", "security_id", "close"), weights, sessions=panels.supplier_sessions(spark, sf_dir), by=by, parts=panels.tasks(panels.read(spark, sf_dir, "lineitem")))
    # a period ends before the next one begins
    nav = nav.where((F.col("period") == "HOLDOUT") | (F.col("session") < F.lit(_SPLIT).cast("date")))
    out = dg.nav_metrics(nav, list(by))
    return out.select(*by, *(rounded(F.col(c)).alias(c) for c in ("total_return", "cagr", "volatility", "sharpe", "max_drawdown")))
