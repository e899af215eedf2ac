"""Composites, gates, non-redundant selection, universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.operators.accounts import one_to_one
from tidepanel.functions import scalar as sc
from tidepanel.operators.ordering import places


def composite(shares: DataFrame, k: int, direction: Column | None = None) -> DataFrame:
    """Equal-weight mean of k (oriented) rank shares per session and security; rows that miss a factor drop out."""
    share = F.col("share") if direction is None else cs.oriented(F.col("share"), direction)
    rows = shares.groupBy("session", "security_id").agg(F.avg(share).alias("score"), F.count(share).alias("n"))
    return rows.where(F.col("n") == k).drop("n")


def composites(shares: DataFrame, pools: dict[str, tuple[str, ...]], directions: DataFrame, by: tuple[str, ...] = ("session", "security_id")) -> DataFrame:
    """Scores of several composites (composite_id, by..., score): the mean of a pool's rank shares, each in its factor's direction;
    NULL where a factor of the pool has none. One group-by for all pools; ``directions`` (factor_id, direction) is a catalogue."""
    told = shares.join(F.broadcast(directions), "factor_id").withColumn("share", cs.oriented(F.col("share"), F.col("direction")))
    of = {name: F.col("factor_id").isin(*pool) for name, pool in pools.items()}
    sums = [x for i, mine in enumerate(of.values()) for x in (F.avg(F.when(mine, F.col("share"))).alias(f"score_{i}"), F.count(F.when(mine, F.col("share"))).alias(f"n_{i}"))]
    wide = told.groupBy(*by).agg(*sums)
    each = [F.struct(F.lit(name).alias("composite_id"), F.when(F.col(f"n_{i}") == len(pool), F.col(f"score_{i}")).alias("score")) for i, (name, pool) in enumerate(pools.items())]
    return wide.select(*by, F.explode(F.array(*each)).alias("c")).select("c.composite_id", *by, "c.score")


def wide_composites(shares: DataFrame, pools: dict[str, tuple[str, ...]], directions: DataFrame) -> DataFrame:
    """``composites`` of rows that have a column for each factor's rank share: each row with composite_id and score, no shuffle."""
    factors = sorted({f for pool in pools.values() for f in pool})
    turned = directions.agg(*(F.max(F.when(F.col("factor_id") == f, F.col("direction"))).alias(f"__{f}") for f in factors))  # one row
    mine = {f: F.when(F.col(f"__{f}").isNotNull(), cs.oriented(F.col(f), F.col(f"__{f}"))) for f in factors}
    mean = lambda pool: reduce(lambda x, y: x + y, (mine[f] for f in pool)) / len(pool)
    each = [F.struct(F.lit(name).alias("composite_id"), mean(pool).alias("score")) for name, pool in pools.items()]
    rest = [c for c in shares.columns if c not in factors]
    return shares.join(F.broadcast(turned)).select(*rest, F.explode(F.array(*each)).alias("__c")).select("__c.composite_id", *rest, "__c.score")


def session_scores(scores: DataFrame, k: int, min_coverage: float = 0.95, min_complete: int = 500) -> DataFrame:
    """Composite scores of every session (session, security_id, composite_score, n_complete, blockers) from rows (factor_id,
    session, security_id, score) of k factors on the whole universe; NULL where a factor is missing. ``blockers`` says what
    stops a session's use: a factor's coverage, or too few complete names."""
    by = ("factor_id", "session")
    value = sc.finite(F.col("score"))
    rows = scores.withColumn("score", value).withColumn("share", cs.rank(F.col("score"), *by))
    thin = rows.groupBy(*by).agg((F.count("score") / F.count("*") < min_coverage).alias("thin")).groupBy("session").agg(F.bool_or("thin").alias("thin"))
    out = rows.groupBy("session", "security_id").agg(F.avg("share").alias("mean"), F.count("share").alias("n"))
    out = out.select("session", "security_id", F.when(F.col("n") == k, F.col("mean")).alias("composite_score"))
    whole = out.groupBy("session").agg(F.count("composite_score").alias("n_complete")).join(thin, "session")
    blockers = F.array_compact(F.array(F.when(F.col("thin"), "ACTIVE_FACTOR_COVERAGE_BELOW_95_PERCENT"), F.when(F.col("n_complete") < min_complete, "COMPLETE_COMPOSITE_BELOW_500")))
    return out.join(F.broadcast(whole.select("session", "n_complete", blockers.alias("blockers"))), "session")  # a row for each session


def review_candidates(catalogue: DataFrame, coverage: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Eligible definitions in structural order within their mechanism, with mechanism_rank and structural_recommendation (its first).

    Order: both providers of ``pair`` first, then coverage (highest), semantic status (full, partial, other), warm-up and id.
    Each id is once in both tables, and each eligible one has a coverage; else the run stops.
    """
    rows = one_to_one(catalogue.where("eligible"), coverage, "factor_id", "left")
    missing = F.raise_error(F.concat(F.lit("CANDIDATE_COVERAGE_MISSING: "), F.col("factor_id").cast("string"))).cast("double")
    both = F.contains(F.col("allowed_providers"), F.lit(pair[0])) & F.contains(F.col("allowed_providers"), F.lit(pair[1]))
    rows = rows.withColumns({"coverage": F.coalesce("coverage", missing), "dual_provider": F.coalesce(both, F.lit(False))})
    semantic = F.when(F.col("semantic_status") == "FULL_INTENT", 0).when(F.col("semantic_status") == "PARTIAL_INTENT", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("mechanism_tag").orderBy(F.desc("dual_provider"), F.desc("coverage"), semantic, "warmup_sessions", "factor_id"))
    return rows.withColumn("mechanism_rank", place).withColumn("structural_recommendation", F.col("mechanism_rank") == 1)


def frozen_directions(ics: DataFrame) -> DataFrame:
    """(factor_id, direction): 1 where the mean correlation of a development period isn't negative, else -1."""
    mean = ics.groupBy("factor_id").agg(F.avg("ic").alias("mean"))
    return mean.select("factor_id", F.when(F.coalesce("mean", F.lit(0.0)) >= 0, 1).otherwise(-1).alias("direction"))


#: Thresholds of the policy: gates, conflicts and size of the pool.
POLICY = {
    "min_median_coverage": 0.95, "min_sessions": 100, "min_positive_years": 0.6, "max_turnover": 0.8,
    "score_corr_conflict": 0.8, "top_overlap_conflict": 0.7, "pool_min": 8, "pool_max": 15,
}


def gate_ladder(policy: dict[str, float] = POLICY) -> list[tuple[str, str, Column]]:
    """The ordered outcomes (status, reason, condition) of data, signal, stability and usability gates; the first that holds decides."""
    def missing(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | ~sc.is_finite(F.col(n).cast("double"))
        return out

    return [
        ("REJECT_DATA", "MISSING_DATA_DIAGNOSTIC", missing("n_sessions", "median_coverage")),
        ("REJECT_DATA", "MEDIAN_COVERAGE_BELOW_MINIMUM", F.col("median_coverage") < policy["min_median_coverage"]),
        ("REJECT_DATA", "VALID_SIGNAL_SESSIONS_BELOW_MINIMUM", F.col("n_sessions") < policy["min_sessions"]),
        ("REJECT_SIGNAL", "MISSING_SIGNAL_DIAGNOSTIC", missing("mean_ic", "spread")),
        ("REJECT_SIGNAL", "NONPOSITIVE_MEAN_RANK_IC", F.col("mean_ic") <= 0),
        ("REJECT_SIGNAL", "NONPOSITIVE_Q5_MINUS_Q1", F.col("spread") <= 0),
        ("WATCHLIST_UNSTABLE", "MISSING_POSITIVE_YEAR_RATIO", missing("positive_year_ratio")),
        ("WATCHLIST_UNSTABLE", "POSITIVE_YEAR_RATIO_BELOW_MINIMUM", F.col("positive_year_ratio") < policy["min_positive_years"]),
        ("WATCHLIST_HIGH_TURNOVER", "MISSING_WEEKLY_TOP10_TURNOVER", missing("turnover")),
        ("WATCHLIST_HIGH_TURNOVER", "WEEKLY_TOP10_TURNOVER_ABOVE_MAXIMUM", F.col("turnover") > policy["max_turnover"]),
        ("PASS_GATES", "PASS_ALL_GATES", F.lit(True)),
    ]


def gated(metrics: DataFrame, policy: dict[str, float] = POLICY) -> DataFrame:
    """Metrics with status and reason of the first outcome that holds. A factor is never turned round: its direction must be 1."""
    if "direction" in metrics.columns:
        metrics = metrics.where(F.when(F.col("direction") == 1, True).otherwise(F.raise_error("FILTER_DIRECTION_MUST_BE_ONE").cast("boolean")))
    said = F.coalesce(*(F.when(holds, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))) for status, reason, holds in gate_ladder(policy)))
    return metrics.withColumn("__said", said).withColumns({"status": F.col("__said.status"), "reason": F.col("__said.reason")}).drop("__said")


#: Stages of the funnel and the statuses that each takes out.
FUNNEL = (
    ("Catalog versions", ()), ("Catalog eligible", ("CATALOG_INELIGIBLE",)), ("Data gate passed", ("REJECT_DATA",)), ("Signal gate passed", ("REJECT_SIGNAL",)),
    ("Stability gate passed", ("WATCHLIST_UNSTABLE",)), ("Usability gate passed", ("WATCHLIST_HIGH_TURNOVER",)), ("Final selected", ("REJECT_REDUNDANT", "REJECT_POOL_CAP")),
)


def funnel(decided: DataFrame) -> DataFrame:
    """How many factors remain after each stage and how many it takes out: rows (stage, name, remaining, removed), from a
    final status for each factor."""
    gone = F.coalesce(*(F.when(F.col("status").isin(*taken), F.lit(i)) for i, (_, taken) in enumerate(FUNNEL) if taken), F.lit(len(FUNNEL)))
    one = decided.select(gone.alias("gone")).agg(*(F.count_if(F.col("gone") > i).alias(f"n{i}") for i in range(len(FUNNEL))))
    stages = F.array(*(F.struct(F.lit(i + 1).alias("stage"), F.lit(name).alias("name"), F.col(f"n{i}").alias("remaining"), (F.col(f"n{max(0, i - 1)}") - F.col(f"n{i}")).alias("removed")) for i, (name, _) in enumerate(FUNNEL)))
    return one.select(F.explode(stages).alias("x")).select("x.*")


def conflicts(passing: DataFrame, measured: DataFrame, policy: dict[str, float] = POLICY, most_candidates: int = 2000) -> DataFrame:
    """All pairs of passing factors with what makes them conflict: family, correlation of scores, overlap of top sets.

    ``passing`` (factor_id, family_id, mechanism_tag) is a catalogue of a few hundred rows, and an error beyond
    ``most_candidates``; ``measured`` has median_abs_ic and top_jaccard of pairs (factor_a, factor_b). A measure that is
    missing is no conflict.
    """
    listed = _gathered(passing, F.struct("factor_id", "family_id", "mechanism_tag"), most_candidates)
    later = lambda x, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = listed.select(F.explode(F.flatten(F.transform("all", later))).alias("p")).select(
        F.col("p.a.factor_id").alias("factor_a"), F.col("p.b.factor_id").alias("factor_b"), F.col("p.a.family_id").eqNullSafe(F.col("p.b.family_id")).alias("same_family"), F.col("p.a.mechanism_tag").eqNullSafe(F.col("p.b.mechanism_tag")).alias("same_mechanism"))
    rows = pairs.join(measured, ["factor_a", "factor_b"], "left")
    reasons = sc.reasons({"SAME_FAMILY": F.col("same_family"), "SCORE_CORRELATION": F.col("median_abs_ic") > policy["score_corr_conflict"], "TOP10_OVERLAP": F.col("top_jaccard") > policy["top_overlap_conflict"]})
    return rows.withColumn("conflict_reason", F.array_join(reasons, "|")).withColumn("hard_conflict", F.col("conflict_reason") != "")


def _gathered(rows: DataFrame, what: Column, most: int) -> DataFrame:
    """One row with the sorted array ``all``; an error if there are more than ``most``, before they are gathered."""
    n = F.count("*").over(Window.partitionBy())
    checked = rows.select(what.alias("__x"), n.alias("__n")).where(F.when(F.col("__n") > most, F.raise_error(F.concat(F.lit("TOO_MANY_CANDIDATES: "), F.col("__n").cast("string"))).cast("boolean")).otherwise(True))
    return checked.agg(F.sort_array(F.collect_list("__x")).alias("all"))


def candidate_order() -> list[Column]:
    """The fixed order of candidates, by ten keys."""
    semantic = F.when(F.col("semantic_status") == "FULL_INTENT", 0).when(F.col("semantic_status") == "PARTIAL_INTENT", 1).otherwise(2)
    return [
        F.desc_nulls_last("positive_year_ratio"), F.desc_nulls_last("icir"), F.desc_nulls_last("mean_ic"), F.desc_nulls_last("spread"), F.asc_nulls_last("turnover"),
        F.desc_nulls_last("median_coverage"), semantic.asc(), F.asc_nulls_last("warmup_sessions"), F.asc("factor_id"), F.asc("factor_version"),
    ]


def greedy(candidates: DataFrame, conflicts: DataFrame, most: int = 15, most_candidates: int = 2000) -> DataFrame:
    """Candidates (factor_id, place) with status and reason: taken in order unless a factor that was taken conflicts, up to ``most``.

    The clash that is named is the first one taken. Candidates are a reviewed catalogue of a few hundred (an error beyond
    ``most_candidates``), so the fold over their ordered array is one row; what is heavy, the comparison of pairs, comes
    before. ``conflicts`` has factor_a and factor_b.
    """
    both = conflicts.select("factor_a", "factor_b").unionByName(conflicts.select(F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b")))
    near = both.groupBy(F.col("factor_a").alias("factor_id")).agg(F.collect_set("factor_b").alias("near"))
    rows = candidates.join(near, "factor_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    listed = _gathered(rows, F.struct(F.col("place").cast("int").alias("place"), "factor_id", "near"), most_candidates)
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<factor_id:string,place:int,status:string,reason:string>>").alias("said"))

    def step(state: Column, row: Column) -> Column:
        clash = F.get(F.filter(state["taken"], lambda t: F.array_contains(row["near"], t)), 0)
        full = F.size(state["taken"]) >= most
        status = F.when(clash.isNotNull(), "REJECT_REDUNDANT").when(full, "REJECT_POOL_CAP").otherwise("SELECTED")
        reason = F.when(clash.isNotNull(), F.concat(F.lit("REJECT_REDUNDANT_WITH_"), clash)).when(full, "ACTIVE_POOL_MAX_REACHED").otherwise("SELECTED_NONREDUNDANT")
        said = F.struct(row["factor_id"].alias("factor_id"), row["place"].alias("place"), status.alias("status"), reason.alias("reason"))
        take = clash.isNull() & ~full
        return F.struct(F.when(take, F.concat(state["taken"], F.array(row["factor_id"]))).otherwise(state["taken"]).alias("taken"), F.concat(state["said"], F.array(said)).alias("said"))

    return listed.select(F.explode(F.aggregate("all", start, step, lambda s: s["said"])).alias("x")).select("x.*")


def pool_messages(decided: DataFrame, least: int = POLICY["pool_min"]) -> DataFrame:
    """One row (n_selected, messages): a pool is never padded, and factors of one mechanism are a warning."""
    taken = F.col("status") == "SELECTED"
    one = decided.agg(F.count_if(taken).alias("n_selected"), F.count_distinct(F.when(taken, F.col("mechanism_tag"))).alias("mechanisms"), F.count_if(taken & F.col("mechanism_tag").isNull()).alias("unnamed"))
    repeated = F.col("n_selected") > F.col("mechanisms") + F.least(F.col("unnamed"), F.lit(1))
    return one.select("n_selected", sc.reasons({"COMPOSITE_BLOCKED_INSUFFICIENT_ALPHA": F.col("n_selected") < least, "SAME_MECHANISM_INCLUDED": repeated}).alias("messages"))


def eligible(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows with the array of failed tests and whether it is empty."""
    return rows.withColumn("reasons", sc.reasons(tests)).withColumn("eligible", F.size("reasons") == 0)


def liquid_universe(rows: DataFrame, tests: dict[str, Column], liquidity: str, least: int, most: int) -> DataFrame:
    """Eligible rows get places by liquidity; the first ``most`` are in, and if fewer than ``least`` are eligible none is."""
    out = eligible(rows, tests)
    placed = places(out.where("eligible").select("security_id", liquidity), liquidity, "security_id").select("security_id", "place")
    n = out.agg(F.count_if("eligible").alias("n_eligible"))
    return out.join(placed, "security_id", "left").join(F.broadcast(n)).withColumn("selected", F.col("eligible") & (F.col("n_eligible") >= least) & (F.col("place") <= most))


def deduplicated(definitions: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Definitions with the id that stands for each semantic identity and why."""
    key = sc.identity(*(F.col(c) for c in identity))
    w = Window.partitionBy("identity").orderBy(*order)
    rows = definitions.withColumn("identity", key)
    return rows.withColumns({"kept_id": F.first("definition_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "place": F.row_number().over(w)}).withColumn("reason", F.when(F.col("place") == 1, "KEPT").otherwise("SAME_IDENTITY"))
