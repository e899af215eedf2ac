"""Definitions of every shape, expected facts with every reason, the log of turned signs."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from tidepanel.operators import quality as dq
from tidepanel.operators.fundamentals import derived
from tidepanel.sources.definitions import read_definitions

DAY = dt.date(2024, 1, 1)


def test_shapes_and_provenance(spark, tmp_path):
    a, b = {"alpha_id": "x", "expression": "rank(close)", "settings": {"n": 1}}, {"id": "x", "code": "rank(open)"}
    files = {
        "list.json": [a, a, b], "records.json": {"records": [a], "source": "s"}, "results.json": {"results": [b]}, "candidates.json": {"candidates": {"k2": b, "k1": {"expression": "y"}}}, "factors.json": {"factors": {"f": a}},
        "map.json": {"m": a, "n": {"settings": {}}}, "one.json": {"alpha_id": "z", "expression": "e"}, "empty.json": [], "text.json": "word"}
    for name, payload in files.items():
        (tmp_path / name).write_text(json.dumps(payload))
    (tmp_path / "broken.json").write_text("{not json")
    found = read_definitions(spark, str(tmp_path)).withColumn("file", F.regexp_extract("source_path", "([^/]+)$", 1)).collect()
    said = {}
    for r in sorted(found, key=lambda r: (r["file"], r["record_index"])):
        assert r["source_sha256"] == hashlib.sha256((tmp_path / r["file"]).read_bytes()).hexdigest()
        said.setdefault(r["file"], []).append((r["candidate_key"], r["alpha_id"], r["expression"], r["settings"]))
    one, two = ("x", "rank(close)", '{"n":1}'), ("x", "rank(open)", None)
    assert said == {
        "list.json": [(None, *one), (None, *one), (None, *two)], "records.json": [(None, *one)], "results.json": [(None, *two)], "candidates.json": [("k1", None, "y", None), ("k2", *two)], "factors.json": [("f", *one)],
        "map.json": [("m", *one), ("n", None, None, "{}")], "one.json": [(None, "z", "e", None)], "text.json": [(None, None, None, None)], "broken.json": [(None, None, None, None)]}
    assert all(r["conflict"] == (r["alpha_id"] == "x") and (r["local_id"] is None) == (r["alpha_id"] is not None) for r in found)
    assert len({r["local_id"] for r in found if r["local_id"]}) == 4


def test_expected_facts(spark):
    versions = spark.createDataFrame([(1, "A", a, v, DAY, 1) for a, v in ((1, 10.0), (2, 20.0), (2, 20.0), (3, 30.0))], "security_id int, field string, accession int, value double, available_at date, source int")
    rows = [
        (1, "A", 1, 10.0, DAY, 1, "REVIEWED", "", "PASS", ""), (1, "A", 1, 11.0, DAY, 1, "REVIEWED", "", "FAIL", "VALUE_TIME_OR_LINEAGE_MISMATCH"), (1, "A", 3, 30.0, dt.date(2024, 1, 2), 1, "REVIEWED", "", "FAIL", "VALUE_TIME_OR_LINEAGE_MISMATCH"),
        (1, "A", 2, 20.0, DAY, 1, "REVIEWED", "", "FAIL", "FACT_MATCH_NOT_UNIQUE"), (1, "A", 9, 1.0, DAY, 1, "REVIEWED", "", "FAIL", "FACT_NOT_FOUND"), (1, "A", 1, 10.0, DAY, 7, "REVIEWED", "", "FAIL", "EXPECTED_RAW_HASH_NOT_IN_VERIFIED_LEDGER"),
        (1, "A", 1, None, DAY, 1, "REVIEWED", "", "FAIL", "EXPECTATION_INCOMPLETE"), (1, "A", 1, None, None, 1, "PENDING", None, "BLOCKED", "EXPECTATION_PENDING_REVIEW"), (1, "A", 1, 1.0, DAY, 1, "BLOCKED", " ", "FAIL", "BLOCK_EVIDENCE_INCOMPLETE"),
        (1, "A", 1, 1.0, DAY, 1, "BLOCKED", "WHY", "BLOCKED", "WHY"), (1, "A", 1, 1.0, DAY, 1, "UNMAPPED", "", "FAIL", "CANONICAL_FIELD_EXISTS"), (1, "B", 1, 1.0, DAY, 1, "UNMAPPED", "", "UNMAPPED", "NO_APPROVED_CANONICAL_TAG"), (1, "A", 1, 1.0, DAY, 1, "OTHER", "", "FAIL", "MANUAL_REVIEW_STATUS_INVALID")]
    expected = spark.createDataFrame([r[:8] for r in rows], "security_id int, field string, accession int, value double, available_at date, source int, review_status string, review_reason string")
    required = spark.createDataFrame([(1, "A"), (1, "C"), (2, "A")], "security_id int, field string")
    out = dq.expected_facts(expected, versions, spark.createDataFrame([(1,)], "source int"), required, ["accession"]).collect()
    missing = [(1, "C", None, "FAIL", "REQUIRED_FIELD_CHECK_MISSING"), (2, "A", None, "FAIL", "REQUIRED_ISSUER_MISSING")]
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(map(repr, [(*r[:3], *r[8:]) for r in rows] + missing))


def test_sign_log(spark):
    row = "array<struct<field:string,sign_convention:string,value:double>>"
    df = spark.createDataFrame([([("a", "positive_outflow", -1.0), ("b", "POSITIVE_EXPENSE", 2.0), ("c", None, -3.0)], [("a", "POSITIVE_ADD_BACK", -1.0)])], f"now {row}, then {row}")
    assert df.select(derived.sign_log(F.col("now"), F.col("then")).alias("m")).first()["m"] == {"a": "ABS_POSITIVE_OUTFLOW", "prior:a": "ABS_POSITIVE_ADD_BACK"}
