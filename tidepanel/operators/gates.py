"""Gates over counts, metrics, pools and targets, and causality checks of point-in-time tables.

All are aggregates and joins over tables; a gate never passes on a missing value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc

#: Fixed by contract: families whose coverage has a threshold without registration, modes and grades of a panel.
PRICE_FAMILIES = {"PRICE": 0.95, "OHLCV": 0.95}
HISTORICAL, FORWARD = "HISTORICAL_DIAGNOSTIC", "FORWARD_OBSERVED"
GRADES = ("SOURCE_LINKED_DIRECT", "SOURCE_LINKED_DERIVED", "HYPOTHESIS_PROXY")


def coverage_gate(counts: DataFrame, least: int = 500) -> DataFrame:
    """Rows (family, eligible, rankable, threshold, ...) with ``coverage`` and ``status``.

    The denominator is all that is eligible. ``threshold`` is the registered one; families of prices have their own, others
    without one are COVERAGE_POLICY_UNREGISTERED. Counts that can't be (more rankable than eligible, negative, missing) are
    INVALID.
    """
    own = reduce(lambda w, f: w.when(F.col("family") == f, F.lit(PRICE_FAMILIES[f])) if w is not None else F.when(F.col("family") == f, F.lit(PRICE_FAMILIES[f])), PRICE_FAMILIES, None)
    limit = F.coalesce(own, F.col("threshold"))
    coverage = F.try_divide(F.col("rankable"), F.col("eligible"))
    sane = F.coalesce((F.col("rankable") >= 0) & (F.col("rankable") <= F.col("eligible")), F.lit(False))
    enough = F.coalesce((coverage >= limit) & (F.col("rankable") >= least), F.lit(False))
    status = F.when(~sane, "INVALID").when(limit.isNull(), "COVERAGE_POLICY_UNREGISTERED").when(enough, "PASS").otherwise("FAIL")
    return counts.withColumns({"coverage": coverage, "status": status})


ALPHA_METRICS = ("complete_years", "gmb_ci_lower", "gmb_mean", "halfyear_segments", "mean_rank_ic", "positive_ic_halfyears", "positive_joint_years")
PORTFOLIO_METRICS = ("active_ci_lower", "active_mean", "benchmark", "corporate_actions_complete", "execution_complete", "max_drawdown", "risk_audit_pass", "stress_active_return")


def metric_gates(metrics: DataFrame, benchmark: str = "B2_risk_matched") -> DataFrame:
    """Rows of metrics with ``alpha_gate``, ``portfolio_gate``, ``execution_status`` and the names of missing metrics.

    Alpha is judged only on passing data, with all its metrics, three complete years and a half year; a portfolio only after
    alpha passed and against the matched benchmark, and fails with alpha.
    """
    c = F.col
    missing_alpha = sc.reasons({m: c(m).isNull() for m in ALPHA_METRICS})
    missing_portfolio = sc.reasons({m: c(m).isNull() for m in PORTFOLIO_METRICS})
    out = metrics.withColumns({"missing_alpha": missing_alpha, "missing_portfolio": missing_portfolio})
    judged = (c("data_gate") == "PASS") & (F.size("missing_alpha") == 0) & (c("complete_years") >= 3) & (c("halfyear_segments") > 0)
    good = (c("mean_rank_ic") > 0.01) & (c("gmb_mean") > 0) & (c("gmb_ci_lower") > 0) & (3 * c("positive_joint_years") >= 2 * c("complete_years")) & (3 * c("positive_ic_halfyears") >= 2 * c("halfyear_segments"))
    out = out.withColumn("alpha_gate", F.when(F.coalesce(judged, F.lit(False)), F.when(good, "ALPHA_VALIDATION_PASS").otherwise("ALPHA_VALIDATION_FAIL")).otherwise("NOT_EVALUABLE"))
    held = (c("alpha_gate") == "ALPHA_VALIDATION_PASS") & (F.size("missing_portfolio") == 0) & (c("benchmark") == benchmark)
    fine = (c("active_mean") > 0) & (c("active_ci_lower") > 0) & (c("max_drawdown") <= 0.25) & (c("stress_active_return") > 0) & c("risk_audit_pass") & c("execution_complete") & c("corporate_actions_complete")
    portfolio = F.when(c("alpha_gate") == "ALPHA_VALIDATION_FAIL", "PORTFOLIO_VALIDATION_FAIL").when(F.coalesce(held, F.lit(False)), F.when(fine, "PORTFOLIO_VALIDATION_PASS").otherwise("PORTFOLIO_VALIDATION_FAIL")).otherwise("NOT_EVALUABLE")
    execution = F.when(c("execution_complete"), "PASS").when(~c("execution_complete"), "FAIL").otherwise("NOT_EVALUABLE")
    return out.withColumns({"portfolio_gate": portfolio, "execution_status": execution})


def pool_validity(pool: DataFrame, conflicts: DataFrame, proposed: DataFrame, least: int = 8, most: int = 15) -> DataFrame:
    """One row (pool_id, members, reasons) for each pool; no reason means a valid one.

    ``pool`` has pool_id, factor_id, family, direction, weight: what was reviewed. ``proposed`` has pool_id, factor_id;
    ``conflicts`` has factor_a, factor_b. Members are 8 to 15 with equal weights that add up to one, each factor and each
    family once, none in conflict, and the reviewed set is the proposed one. A pool that only one table has is judged too.
    """
    facts = pool.groupBy("pool_id").agg(
        F.count("*").alias("members"), F.count_distinct("factor_id").alias("factors"), F.count_distinct("family").alias("families"), F.count_if(F.col("family").isNotNull()).alias("named"),
        F.count_if(~F.coalesce(F.col("direction") == 1, F.lit(False))).alias("turned"), F.sum("weight").alias("total"), (F.max("weight") - F.min("weight")).alias("spread"))
    member = pool.select("pool_id", "factor_id").distinct()
    a, b = member.withColumnRenamed("factor_id", "factor_a"), member.withColumnRenamed("factor_id", "factor_b")
    clashing = a.join(conflicts.select("factor_a", "factor_b").distinct(), "factor_a").join(b, ["pool_id", "factor_b"]).groupBy("pool_id").agg(F.count("*").alias("clashes"))
    sides = member.withColumn("r", F.lit(1)).join(proposed.select("pool_id", "factor_id").distinct().withColumn("p", F.lit(1)), ["pool_id", "factor_id"], "full_outer")
    sets = sides.groupBy("pool_id").agg(F.count_if(F.col("p").isNull()).alias("unproposed"), F.count_if(F.col("r").isNull()).alias("unreviewed"))
    rows = sets.join(facts, "pool_id", "left").join(clashing, "pool_id", "left")
    n = F.coalesce("members", F.lit(0))
    return rows.select("pool_id", n.alias("members"), sc.reasons({
        "ACTIVE_POOL_SIZE": ~n.between(least, most), "DUPLICATE_FACTOR": F.col("factors") < F.col("members"), "DIRECTION_MUST_REMAIN_ONE": F.col("turned") > 0,
        "WEIGHTS_NOT_EQUAL": ~F.coalesce((F.abs(F.col("total") - 1) <= 1e-9) & (F.col("spread") <= 1e-9), F.lit(False)), "DUPLICATE_FAMILY": F.col("families") < F.col("named"),
        "UNRESOLVED_FACTOR_CONFLICT": F.col("clashes") > 0, "REVIEW_FACTOR_NOT_PROPOSED": F.col("unproposed") > 0, "REVIEW_DECISION_INCOMPLETE": F.col("unreviewed") > 0,
    }).alias("reasons"))


def target_checks(targets: DataFrame, *by: str, tolerance: float = 1e-12) -> DataFrame:
    """For each batch (``by``) the reasons against its weights: a security twice, a weight outside 0 to 1, a sum above one."""
    w = F.col("weight")
    one = targets.groupBy(*by).agg((F.count("*") - F.count_distinct("security_id")).alias("twice"), F.count_if(~F.coalesce(w.between(0, 1), F.lit(False))).alias("outside"), F.sum("weight").alias("total"))
    return one.select(*by, sc.reasons({"DUPLICATE_SECURITY": F.col("twice") > 0, "WEIGHT_OUT_OF_RANGE": F.col("outside") > 0, "WEIGHT_SUM": F.col("total") > 1 + tolerance}).alias("reasons"))


def count_gates(table: DataFrame, gates: dict[str, tuple[Column, int | None, int | None]]) -> DataFrame:
    """Rows (gate, value, passed): aggregates of a table with the least and most that each may be (None: no bound)."""
    one = table.agg(*(value.cast("long").alias(name) for name, (value, _, _) in gates.items())).unpivot([], list(gates), "gate", "value")
    ok = F.lit(None).cast("boolean")
    for name, (_, least, most) in gates.items():
        inside = F.lit(True)
        inside = inside & (F.col("value") >= least) if least is not None else inside
        inside = inside & (F.col("value") <= most) if most is not None else inside
        ok = F.when(F.col("gate") == name, F.coalesce(inside, F.lit(False))).otherwise(ok)
    return one.withColumn("passed", ok)


def turnover_summary(batches: DataFrame, *by: str, cap: float = 0.20) -> DataFrame:
    """Of batches (desired, initial) how many have a turnover, how many lack one, are initial, or are bound by the cap."""
    binding = F.count_if(F.col("desired") > cap)
    return batches.groupBy(*by).agg(
        F.count("*").alias("scheduled"), F.count("desired").alias("computable"), F.count_if(F.col("desired").isNull()).alias("missing"), F.count_if("initial").alias("initial"),
        binding.alias("binding"), F.try_divide(binding, F.count("desired")).alias("binding_rate"))


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit(""))) == ""


LINEAGE = ("source_id", "security_id", "field", "basis")


def causality_checks(versions: DataFrame, panel: DataFrame, parts: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Nineteen checks (check, failed_rows) of a panel against the versions it was made of.

    ``versions``: source_id, raw_hash, historical_at, seen_at, available_at, status, field, basis, issuer, security_id,
    accession, value, unit. ``panel``: source_id, cutoff, selected_at, mode, field, basis, issuer, security_id, value, unit,
    accession. A panel row resolves if exactly one version has its source, security, field and basis; a row that does not
    counts against each check that compares the two. Rows of both that have a key are one sequence, versions first, so repeats
    make no pairs and both tables are dealt and sorted once; ``parts`` is the number of tasks that keys are dealt to, Spark's own
    if None. ``by`` names columns of both tables that follow from the source, so that equal keys have them equal: where both
    tables are already dealt by these to as many tasks, rows stay there.
    """
    c = F.col
    time = lambda n: c(n).try_cast("timestamp")
    held = c("available_at").isNotNull() & (time("available_at") >= time("historical_at")) & (time("available_at") >= time("seen_at"))
    bad_versions = {
        "version_times_parse": time("historical_at").isNull() | time("seen_at").isNull() | time("available_at").isNull(),
        "forward_never_precedes_historical": ~F.coalesce(held, F.lit(False)),
        "version_lineage_complete": c("source_id").isNull() | _blank(c("accession")),
        "raw_hashes_present": ~sc.is_hash(c("raw_hash")),
        "mapped_fields_named": (c("status") == "MAPPED") & _blank(c("field")),
        "version_values_are_finite": ~F.coalesce(sc.is_finite(c("value")), F.lit(False)),
    }
    of_versions = versions.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("versions_nonempty"), *(F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in bad_versions.items()))
    told = ("historical_at", "available_at", "issuer", "accession", "value", "unit")
    key = list(dict.fromkeys((*by, *LINEAGE)))
    known = versions.select(*key, F.lit(0).alias("__side"), *(c(x).alias(f"v_{x}") for x in told))
    judged = panel.select(*key, F.lit(1).alias("__side"), "cutoff", "selected_at", "mode", "issuer", "accession", "value", "unit")
    rows = known.unionByName(judged, allowMissingColumns=True)
    if parts is not None and not by:
        rows = rows.repartition(parts, *LINEAGE)
    of_version = c("__side") == 0
    w = Window.partitionBy(*key).orderBy("__side")
    rows = rows.withColumns({"__n": F.count_if(of_version).over(w)} | {f"v_{x}": F.first(f"v_{x}").over(w) for x in told})
    resolved = F.coalesce((c("__n") == 1) & c("v_historical_at").isNotNull(), F.lit(False)) & reduce(lambda a, b: a & b, (c(x).isNotNull() for x in LINEAGE))
    text = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    same = (F.lpad(text("issuer"), 10, "0") == F.lpad(text("v_issuer"), 10, "0")) & (text("accession") == text("v_accession")) & (text("unit") == text("v_unit"))
    expected = F.when(c("mode") == HISTORICAL, time("v_historical_at")).when(c("mode") == FORWARD, time("v_available_at"))
    good_panel = {
        "panel_times_parse": time("cutoff").isNotNull() & time("selected_at").isNotNull(),
        "no_future_values": time("selected_at") <= time("cutoff"),
        "panel_lineage_resolves": resolved,
        "panel_lineage_metadata_matches": resolved & same,
        "panel_values_match_versions": resolved & sc.is_finite(c("value")) & (F.abs(c("value") - c("v_value")) <= 1e-12),
        "panel_selected_availability_matches_source": resolved & (time("selected_at") == expected),
        "panel_lineage_complete": c("source_id").isNotNull() & ~_blank(c("accession")),
        "availability_modes_known": c("mode").isin(HISTORICAL, FORWARD),
        "values_are_finite": sc.is_finite(c("value")),
        "units_present": ~_blank(c("unit")),
    }
    of_rows = rows.agg(
        F.count_if(of_version & ((c("__n") > 1) | _blank(c("source_id")))).alias("version_lineage_keys_unique"), F.when(F.count_if(~of_version) == 0, 1).otherwise(0).cast("long").alias("panel_nonempty"),
        *(F.count_if(~of_version & ~F.coalesce(t, F.lit(False))).alias(k) for k, t in good_panel.items()))
    return reduce(DataFrame.unionByName, (p.unpivot([], p.columns, "check", "failed_rows") for p in (of_versions, of_rows)))


REQUIRED = ("security_id", "issuer", "field", "basis", "unit", "accession", "source_id", "grade", "mapping_version")


def load_checks(panel: DataFrame, mode: str) -> DataFrame:
    """Rules (check, failed_rows) that a panel read for one mode must keep: nothing missing or blank, times in order, no look
    ahead, sessions at midnight, numbers as values, known grades."""
    c = F.col
    time = lambda n: c(n).try_cast("timestamp")
    times = ("cutoff", "selected_at", "historical_at", "seen_at", "available_at")
    selected = time("historical_at") if mode == HISTORICAL else time("available_at")
    good = {
        "TIME_INVALID": reduce(lambda a, b: a & b, (time(t).isNotNull() for t in times)),
        "REQUIRED_VALUE_MISSING": reduce(lambda a, b: a & b, (~_blank(c(x)) for x in REQUIRED)),
        "AVAILABLE_AT_INVARIANT": (time("available_at") >= time("historical_at")) & (time("available_at") >= time("seen_at")),
        "SELECTED_AVAILABILITY_MISMATCH": time("selected_at") == selected,
        "LOOKAHEAD": time("selected_at") <= time("cutoff"),
        "SESSION_NOT_NORMALIZED": c("session").cast("timestamp") == F.date_trunc("day", "session"),
        "VALUE_NOT_NUMERIC": c("value").try_cast("double").isNotNull(),
        "SEMANTIC_GRADE_UNKNOWN": c("grade").isin(*GRADES),
    }
    one = panel.agg(*(F.count_if(~F.coalesce(t, F.lit(False))).alias(k) for k, t in good.items()))
    return one.unpivot([], list(good), "check", "failed_rows")
