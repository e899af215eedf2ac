"""Definitions read from files of several shapes, facts reconciled with what was expected, the log of signs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidepanel.operators import quality as dq
from tidepanel.plans.derived_queries import ORACLE_PARTS, derived_fields
from tidepanel.plans.registry import query
from tidepanel.sources import panels
from tidepanel.sources.definitions import read_definitions
from tidepanel.sources.panels import SQL_VERSIONS, read
from tidepanel.sources.shared import scratch, written

#: One record of a part, and its key; the same text in both dialects.
_RECORD = """concat('{', CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('"id":"', CAST(p_partkey % 40 AS STRING), ' ', CAST(p_size AS STRING), '",') END, '"expression":"', p_type, '","settings":{"n":', CAST(p_partkey % 3 AS STRING), '}}')"""
_KEY = "concat('k', lpad(CAST(p_partkey AS STRING), 9, '0'))"
_SHAPES = ("concat('[', {records}, ']')", """concat('{{"sync_scope_complete":true,"records":[', {records}, ']}}')""", """concat('{{"candidates":{{', {entries}, '}}}}')""", "concat('{{', {entries}, '}}')")


@query("src_12_definition_shapes", f"""WITH r AS (SELECT p_brand, CAST(substr(p_brand, 7) AS INT) % 4 AS shape, p_partkey, {_RECORD.replace("AS STRING", "AS VARCHAR")} AS record, {_KEY.replace("AS STRING", "AS VARCHAR")} AS key, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 40) || ' ' || p_size END AS alpha_id, p_type AS expression, '{{"n":' || p_partkey % 3 || '}}' AS settings FROM part),
f AS (SELECT p_brand, any_value(shape) AS shape, string_agg(record, ',' ORDER BY p_partkey) AS records, string_agg('"' || key || '":' || record, ',' ORDER BY p_partkey) AS entries FROM r GROUP BY 1),
h AS (SELECT p_brand, sha256((CASE shape {" ".join(f"WHEN {i} THEN {s.format(records='records', entries='entries')}" for i, s in enumerate(_SHAPES))} END) || chr(10)) AS source_sha256 FROM f),
d AS (SELECT p_brand, source_sha256, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS record_index, CASE WHEN shape >= 2 THEN key END AS candidate_key, alpha_id, sha256(expression || '|' || settings) AS definition_hash FROM r JOIN h USING (p_brand))
SELECT p_brand, source_sha256, record_index, candidate_key, alpha_id, CASE WHEN alpha_id IS NULL THEN 'local-' || sha256(source_sha256 || '|' || record_index || '|' || coalesce(candidate_key, ''))[1:20] END AS local_id, definition_hash,
  alpha_id IS NOT NULL AND min(definition_hash) OVER (PARTITION BY alpha_id) <> max(definition_hash) OVER (PARTITION BY alpha_id) AS conflict FROM d""")
def src_12(spark, sf_dir):
    """Parts as definitions: a file for each brand, of four shapes, written and read back with provenance."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(_RECORD).alias("record"), F.expr(_KEY).alias("key"))
    lists = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "key", "record"))).alias("l"))
    joined = lists.select("p_brand", (F.substring("p_brand", 7, 9).cast("int") % 4).alias("shape"), F.array_join("l.record", ",").alias("records"), F.array_join(F.transform("l", lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["record"])), ",").alias("entries"))
    shape = F.lit(None).cast("string")
    for i, s in enumerate(_SHAPES):
        shape = F.when(F.col("shape") == i, F.expr(s.format(records="records", entries="entries"))).otherwise(shape)
    path = scratch(spark, "definitions")
    joined.select(F.substring("p_brand", 7, 9).alias("brand"), shape.alias("value")).repartition("brand").write.partitionBy("brand").text(path)
    found = read_definitions(spark, f"{path}/*/*.txt").withColumn("p_brand", F.concat(F.lit("Brand#"), F.regexp_extract("source_path", "/brand=([^/]+)/", 1)))
    return found.select("p_brand", "source_sha256", F.col("record_index").cast("long").alias("record_index"), "candidate_key", "alpha_id", "local_id", "definition_hash", "conflict")


_EXPECTED = """SELECT security_id, field, accession, period_end, CASE WHEN accession % 41 = 0 THEN NULL ELSE value + CASE WHEN accession % 13 = 0 THEN 1 ELSE 0 END END AS value, CASE WHEN accession % 17 = 0 THEN available_at + 1 ELSE available_at END AS available_at,
  CASE WHEN accession % 19 = 0 THEN 'EUR' ELSE 'USD' END AS unit, CASE accession % 11 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'UNMAPPED' ELSE 'REVIEWED' END AS review_status, CASE WHEN accession % 2 = 0 THEN 'SCOPE' ELSE '' END AS review_reason, accession % 23 AS source FROM versions_l WHERE accession % 3 = 0"""


@query("dq_06_expected_facts", f"""WITH {SQL_VERSIONS}, e AS ({_EXPECTED}), v AS (SELECT *, 'USD' AS unit FROM versions_l WHERE accession % 29 <> 0 UNION ALL SELECT *, 'USD' FROM versions_l WHERE accession % 31 = 0 AND accession % 29 <> 0),
m AS (SELECT e.*, (SELECT count(*) FROM v WHERE v.security_id = e.security_id AND v.field = e.field AND v.accession = e.accession AND v.period_end = e.period_end AND v.unit = e.unit) AS n FROM e),
j AS (SELECT m.*, v.value AS vv, v.available_at AS va FROM m LEFT JOIN v ON n = 1 AND v.security_id = m.security_id AND v.field = m.field AND v.accession = m.accession AND v.period_end = m.period_end AND v.unit = m.unit),
k AS (SELECT *, EXISTS (SELECT 1 FROM v WHERE v.security_id = j.security_id AND v.field = j.field) AS mapped FROM j),
s AS (SELECT security_id, field, accession, period_end, CASE WHEN review_status = 'PENDING' THEN 'BLOCKED/EXPECTATION_PENDING_REVIEW' WHEN review_status = 'BLOCKED' THEN CASE WHEN review_reason = '' THEN 'FAIL/BLOCK_EVIDENCE_INCOMPLETE' ELSE 'BLOCKED/' || review_reason END
  WHEN review_status = 'UNMAPPED' THEN CASE WHEN mapped THEN 'FAIL/CANONICAL_FIELD_EXISTS' ELSE 'UNMAPPED/NO_APPROVED_CANONICAL_TAG' END WHEN value IS NULL THEN 'FAIL/EXPECTATION_INCOMPLETE' WHEN source = 5 THEN 'FAIL/EXPECTED_RAW_HASH_NOT_IN_VERIFIED_LEDGER'
  WHEN n = 0 THEN 'FAIL/FACT_NOT_FOUND' WHEN n > 1 THEN 'FAIL/FACT_MATCH_NOT_UNIQUE' WHEN abs(vv - value) > 1e-9 * greatest(abs(vv), abs(value)) OR va <> available_at THEN 'FAIL/VALUE_TIME_OR_LINEAGE_MISMATCH' ELSE 'PASS/' END AS x FROM k)
SELECT security_id, field, accession, period_end, split_part(x, '/', 1) AS status, split_part(x, '/', 2) AS reason FROM s
UNION ALL SELECT s_suppkey, f, NULL, NULL, 'FAIL', CASE WHEN s_suppkey NOT IN (SELECT security_id FROM e) THEN 'REQUIRED_ISSUER_MISSING' ELSE 'REQUIRED_FIELD_CHECK_MISSING' END FROM supplier, (VALUES ('A'), ('N'), ('R'), ('X')) t(f) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.security_id = s_suppkey AND e.field = f)""")
def dq_06(spark, sf_dir):
    """A third of all facts as expectations under review, against versions of which some are lost and some double."""
    v = written(panels.versions(spark, sf_dir), "versions").withColumn("unit", F.lit("USD"))  # expectations and what they are met with
    key = F.col("accession")
    e = v.where("accession % 3 = 0").select(
        "security_id", "field", "accession", "period_end", F.when(key % 41 != 0, F.col("value") + F.when(key % 13 == 0, 1).otherwise(0)).alias("value"), F.when(key % 17 == 0, F.date_add("available_at", 1)).otherwise(F.col("available_at")).alias("available_at"),
        F.when(key % 19 == 0, "EUR").otherwise("USD").alias("unit"), F.when(key % 11 == 0, "PENDING").when(key % 11 == 1, "BLOCKED").when(key % 11 == 2, "UNMAPPED").otherwise("REVIEWED").alias("review_status"), F.when(key % 2 == 0, "SCOPE").otherwise("").alias("review_reason"), (key % 23).alias("source"))
    kept = v.where("accession % 29 != 0")
    have = kept.unionByName(kept.where("accession % 31 = 0"))
    ledger = spark.range(23).where("id != 5").select(F.col("id").alias("source"))
    required = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"), F.explode(F.array(*map(F.lit, "ANRX"))).alias("field"))
    return dq.expected_facts(e, have, ledger, required, ["accession", "period_end", "unit"], parts=panels.tasks(read(spark, sf_dir, "lineitem"))).select("security_id", "field", "accession", "period_end", "status", "reason")


@query("fd_09_transformation_log", re.sub(r"\bat\b", '"at"', f"""{ORACLE_PARTS} SELECT security_id, at, field, tr AS transformations FROM (SELECT * FROM made1 UNION ALL SELECT * FROM made2) WHERE reason IS NULL"""))
def fd_09(spark, sf_dir):
    """Which inputs of each derived value were made positive, and by which convention."""
    out = derived_fields(spark, sf_dir).where("reason is null")
    log = F.array_join(F.transform(F.map_entries("transformations"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return out.select("security_id", "at", "field", log.alias("transformations"))
