"""Secrets in texts, found once per distinct text with an incremental blob ledger, in DataFrame functions only.

Every version of a text is named by its SHA-256, every rule by a hash of all it says. The ledger, a Parquet folder that only
grows, has a row for each scan of a blob: which rule versions were tried and what they found. A run scans a blob only under
rules whose version the ledger lacks for it, then joins findings of the present rules back to every path.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import shared_dir, staged, table
from tidepanel.llm.native_spans import matches
from tidepanel.llm.span_sql import PLAIN, WHOLE, matches_sql

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: (kind, pattern, least length of the match, words of which a text must hold one in lower case, pattern it must match)
RULES = (
    ("assign", _ASSIGN, 1, ("password", "passwd", "secret", "token", "apikey", "api_key"), None),
    ("access", r"AKIA[A-Z0-9]+", 20, ("akia",), None),
    ("hex", r"[0-9a-f]+", 24, (), r"[0-9a-f]{24}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, ("-----begin ",), None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, ("eyj",), None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, ("xox",), None),
)
KINDS = tuple(r[0] for r in RULES)
BASE_KINDS = KINDS[:3]
SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,rule:string>>"
LEDGER = f"digest string, rules array<string>, spans {SPANS}"


def rule_version(rule: tuple) -> str:
    """Changes with every change of the rule."""
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def _at_least(size: int):
    return lambda m: m["end"] - m["start"] >= size


def _row(no: int, kind: str, version: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(version).alias("rule"))


def secret_spans(text: Column, lowered: Column, todo: Column, rules: tuple = RULES) -> Column:
    """Structs (start, kind_no, end, kind, rule) of one text under the rules whose versions are in ``todo``; ``lowered`` is the
    text in lower case."""
    found = []
    for no, (kind, pattern, least, words, gate) in enumerate(rules):
        version = rule_version(rules[no])
        test = F.array_contains(todo, version)
        if gate is not None:
            test = test & text.rlike(gate)
        if words:
            any_word = F.contains(lowered, F.lit(words[0]))
            for w in words[1:]:
                any_word = any_word | F.contains(lowered, F.lit(w))
            test = test & any_word
        hits = matches(text, pattern)
        if kind == "assign":
            # the value, which ends the match, has six characters or more
            hits = F.filter(hits, lambda m: F.length(F.regexp_replace(m["text"], f"^{_ASSIGN_HEAD}", "")) >= 6)
        else:
            hits = F.filter(hits, _at_least(least))
        found.append(F.when(test, F.transform(hits, _row(no, kind, version))).otherwise(F.array().cast(SPANS)))
    return F.concat(*found)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None where nothing has been written yet."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
        ledger.columns  # noqa: B018
        return ledger
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def scan_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Rows (id, digest, spans), one for each row of ``docs``; spans are structs (start, kind_no, end, kind, rule), sorted.

    ``ledger`` is a folder that all machines share; blobs that it has under all present rules are not read again, and what this
    run scans is added. A run that ends early leaves rows that are true by themselves. Without it all blobs are scanned.

    Null texts are empty texts; very long ones are scanned whole. Ids may be null or repeat: each row gets the findings of its
    own text, and equal texts are scanned once. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    versions_ = [rule_version(r) for r in rules]
    present = F.array(*map(F.lit, versions_))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    versions = staged(rows.select("id", "key", "digest"), "versions")
    blobs = versions.groupBy("digest").agg(F.min("key").alias("key"))
    known = None if ledger is None else read_ledger(spark, ledger)
    if known is None:
        blobs = blobs.withColumn("todo", present)
    else:
        seen = known.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = F.array_except(present, F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.join(seen, "digest", "left").select("digest", "key", todo.alias("todo")).where(F.size("todo") > 0)
    # each blob goes by one key; rows that repeat key and text are brought to one before the scan
    unseen = rows.join(blobs, ["key", "digest"]).groupBy("key", "digest").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    scanned = unseen.select("digest", F.col("todo").alias("rules"), secret_spans(F.col("text"), F.lower("text"), F.col("todo"), rules).alias("spans"))
    if ledger is None:
        whole = staged(scanned, "scanned")
    else:
        scanned.hint("rebalance").write.mode("append").parquet(ledger)
        whole = read_ledger(spark, ledger)
    # a blob has a row for each run that scanned it
    whole = whole.where(F.size("spans") > 0).groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = whole.select("digest", F.array_sort(F.filter("spans", lambda s: F.array_contains(present, s["rule"]))).alias("spans"))
    found = versions.select("id", "digest").join(hits, "digest", "left")
    return found.select("id", "digest", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined_spans(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def ledger_of(spark: SparkSession, sf_dir: str) -> str:
    """The ledger of a table, in the folder that all machines share."""
    return f"{shared_dir(spark)}/secret-ledger-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, through the table's ledger: what an earlier run has scanned is not scanned
    again. Nulls, empty and long texts, ties and repeats as in ``scan_secrets``."""
    found = scan_secrets(table(spark, sf_dir, "documents"), ledger_of(spark, sf_dir))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined_spans(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = f"""
WITH d AS ({PLAIN}), {matches_sql([(k, _quoted(p), WHOLE) for k, p, *_ in RULES], "d")}, ok AS (
  SELECT doc_id, kind, o, b, e FROM found WHERE CASE kind
    WHEN 'assign' THEN length(regexp_replace(s, '^{_quoted(_ASSIGN_HEAD)}', '')) >= 6
    WHEN 'access' THEN length(s) >= 20 WHEN 'hex' THEN length(s) >= 24 ELSE true END
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN ok USING (doc_id) GROUP BY d.doc_id
"""
