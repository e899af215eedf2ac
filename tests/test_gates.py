"""Gates and causality checks on rows made for each outcome."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidepanel.operators import gates
from tidepanel.plans.all import QUERIES

BEST = dict(data_gate="PASS", mean_rank_ic=0.02, gmb_mean=0.1, gmb_ci_lower=0.01, complete_years=3, positive_joint_years=2, halfyear_segments=6, positive_ic_halfyears=4, active_mean=0.1, active_ci_lower=0.01,
    max_drawdown=0.25, stress_active_return=0.01, benchmark="B2_risk_matched", risk_audit_pass=True, execution_complete=True, corporate_actions_complete=True)
SCHEMA = ("name string, data_gate string, mean_rank_ic double, gmb_mean double, gmb_ci_lower double, complete_years long, positive_joint_years long, halfyear_segments long, positive_ic_halfyears long, active_mean double, active_ci_lower double,"
    "max_drawdown double, stress_active_return double, benchmark string, risk_audit_pass boolean, execution_complete boolean, corporate_actions_complete boolean")


def test_metric_gates(spark):
    cases = {"best": {}, "few_years": {"complete_years": 2, "positive_joint_years": 2}, "weak": {"mean_rank_ic": 0.01}, "no_ic": {"mean_rank_ic": None}, "deep": {"max_drawdown": 0.26}, "other": {"benchmark": "B1"}, "no_benchmark": {"benchmark": None}, "unexecuted": {"execution_complete": None}, "bad_data": {"data_gate": "FAIL"}}
    rows = [{"name": n, **BEST, **c} for n, c in cases.items()]
    out = {r["name"]: r for r in gates.metric_gates(spark.createDataFrame(rows, SCHEMA)).collect()}
    said = {n: (r["alpha_gate"].rpartition("_")[2], r["portfolio_gate"].rpartition("_")[2], r["execution_status"]) for n, r in out.items()}
    assert said == {
        "best": ("PASS", "PASS", "PASS"), "few_years": ("EVALUABLE", "EVALUABLE", "PASS"), "weak": ("FAIL", "FAIL", "PASS"), "no_ic": ("EVALUABLE", "EVALUABLE", "PASS"), "deep": ("PASS", "FAIL", "PASS"),
        "other": ("PASS", "EVALUABLE", "PASS"), "no_benchmark": ("PASS", "EVALUABLE", "PASS"), "unexecuted": ("PASS", "EVALUABLE", "NOT_EVALUABLE"), "bad_data": ("EVALUABLE", "EVALUABLE", "PASS")}
    assert out["no_ic"]["missing_alpha"] == ["mean_rank_ic"] and out["unexecuted"]["missing_portfolio"] == ["execution_complete"]


def test_coverage_gate(spark):
    rows = [("PRICE", 1000, 950, None), ("PRICE", 1000, 949, None), ("OHLCV", 500, 499, None), ("NEWS", 1000, 1000, None), ("NEWS", 1000, 600, 0.6), ("PRICE", 10, 11, None), ("PRICE", 0, 0, None)]
    out = gates.coverage_gate(spark.createDataFrame(rows, "family string, eligible long, rankable long, threshold double"))
    assert [r["status"] for r in out.collect()] == ["PASS", "FAIL", "FAIL", "COVERAGE_POLICY_UNREGISTERED", "PASS", "INVALID", "FAIL"]


def test_pool_validity(spark):
    def pool(name, n, **over):
        return [dict(pool_id=name, factor_id=f"{name}{i}", family=f"f{i}", direction=1, weight=1.0 / n) | (over if i == 0 else {}) for i in range(n)]

    rows = pool("ok", 8) + pool("small", 7) + pool("large", 16) + pool("turned", 8, direction=-1) + pool("heavy", 8, weight=0.5) + pool("family", 8, family="f1") + pool("clash", 8) + pool("extra", 8) + pool("lacks", 8)
    df = spark.createDataFrame(rows, "pool_id string, factor_id string, family string, direction int, weight double")
    proposed = df.where("factor_id != 'extra0'").select("pool_id", "factor_id").unionByName(spark.createDataFrame([("lacks", "lacks9"), ("gone", "gone1")], "pool_id string, factor_id string"))
    conflicts = spark.createDataFrame([("clash0", "clash7"), ("ok0", "clash1")], "factor_a string, factor_b string")
    assert {r["pool_id"]: ",".join(r["reasons"]) for r in gates.pool_validity(df, conflicts, proposed).collect()} == {
        "ok": "", "small": "ACTIVE_POOL_SIZE", "large": "ACTIVE_POOL_SIZE", "turned": "DIRECTION_MUST_REMAIN_ONE", "heavy": "WEIGHTS_NOT_EQUAL", "family": "DUPLICATE_FAMILY", "clash": "UNRESOLVED_FACTOR_CONFLICT",
        "extra": "REVIEW_FACTOR_NOT_PROPOSED", "lacks": "REVIEW_DECISION_INCOMPLETE", "gone": "ACTIVE_POOL_SIZE,WEIGHTS_NOT_EQUAL,REVIEW_DECISION_INCOMPLETE"}


def test_target_checks(spark):
    rows = [("ok", "a", 0.5), ("ok", "b", 0.5), ("twice", "a", 0.1), ("twice", "a", 0.1), ("low", "a", -0.1), ("none", "a", None), ("sum", "a", 0.6), ("sum", "b", 0.6)]
    out = gates.target_checks(spark.createDataFrame(rows, "batch string, security_id string, weight double"), "batch")
    assert {r["batch"]: ",".join(r["reasons"]) for r in out.collect()} == {"ok": "", "twice": "DUPLICATE_SECURITY", "low": "WEIGHT_OUT_OF_RANGE", "none": "WEIGHT_OUT_OF_RANGE", "sum": "WEIGHT_SUM"}


V = "source_id string, raw_hash string, historical_at string, seen_at string, available_at string, status string, field string, basis string, issuer string, security_id string, accession string, value double, unit string"
P = "source_id string, cutoff string, selected_at string, mode string, field string, basis string, issuer string, security_id string, value double, unit string, accession string"


def test_causality_clean_and_empty(spark):
    v = spark.createDataFrame([("s1", "a" * 64, "2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-02 10:00:00", "MAPPED", "revenue", "RAW", "12", "x", "acc", 1.0, "usd")], V)
    p = spark.createDataFrame([("s1", "2024-01-03", "2024-01-01 10:00:00", gates.HISTORICAL, "revenue", "RAW", "0000000012", "x", 1.0, "usd", "acc")], P)
    clean = gates.causality_checks(v, p).collect()
    assert len(clean) == 19 and all(r["failed_rows"] == 0 for r in clean)
    empty = {r["check"] for r in gates.causality_checks(v.limit(0), p.limit(0)).collect() if r["failed_rows"]}
    assert empty == {"versions_nonempty", "panel_nonempty"}
    late = {r["check"] for r in gates.causality_checks(v.withColumn("available_at", F.lit("nonsense")), p.withColumn("cutoff", F.lit("2023-12-31"))).collect() if r["failed_rows"]}
    assert late == {"version_times_parse", "forward_never_precedes_historical", "no_future_values"}


def test_causality_repeats_and_gaps(spark):
    def version(source):
        return (source, "a" * 64, "2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-02 10:00:00", "MAPPED", "revenue", "RAW", "12", "x", "acc", 1.0, "usd")

    def row(source, day=1, basis="RAW", value=1.0):
        return (source, "2024-01-03", f"2024-01-0{day} 10:00:00", gates.HISTORICAL, "revenue", basis, "0000000012", "x", value, "usd", "acc")

    order = F.coalesce(F.substring("source_id", 2, 1).cast("int"), F.lit(0)).alias("order")
    v = spark.createDataFrame([version(s) for s in ("s1", "s2", "s2", None)], V).select("*", order)
    p = spark.createDataFrame([row("s1"), row("s1", value=2.0), row("s1", day=2), row("s2"), row(None), row("s4"), row("s1", basis="TTM")], P).select("*", order)
    want = {"version_lineage_complete": 1, "version_lineage_keys_unique": 3, "panel_lineage_resolves": 4, "panel_lineage_metadata_matches": 4, "panel_values_match_versions": 5, "panel_selected_availability_matches_source": 5, "panel_lineage_complete": 1}
    by_source = v.repartition(3, "source_id"), p.repartition(3, "source_id")
    for out in (gates.causality_checks(v, p), gates.causality_checks(v, p, 3), gates.causality_checks(v.repartition(3, "order"), p.repartition(3, "order"), by=("order",)), gates.causality_checks(*by_source, by=("source_id",))):
        said = {r["check"]: r["failed_rows"] for r in out.collect()}
        assert len(said) == 19 and {k: n for k, n in said.items() if n} == want


def shuffles(df):
    """The first key of each shuffle of a plan that deals rows by key."""
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_causality_deals_keys_once(spark):
    one = spark.range(1).select(F.col("id").cast("string").alias("text"), F.lit("RAW").alias("basis"))
    v, p = (one.select(*("basis" if n == "basis" else F.col("text").cast(t).alias(n) for n, t in (c.split() for c in names.split(", ")))) for names in (V, P))
    assert shuffles(gates.causality_checks(v, p, 7)) == ["source_id"]


def test_causality_facts_stay_with_their_order(spark):
    assert set(shuffles(QUERIES["dq_04_causality_contract"](spark, "/root/testdata/sf0.001"))) == {"l_orderkey", "o_orderkey"}
