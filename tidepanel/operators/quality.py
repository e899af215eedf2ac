"""Data-quality checks: rows (check, failed_rows), and an error where one fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check failed; the message begins with its code."""


def count_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each rule how many rows break it, in one pass; a rule is true where a row is good, and NULL is bad."""
    one = df.agg(*(F.count_if(~F.coalesce(good, F.lit(False))).alias(code) for code, good in rules.items()))
    return one.unpivot([], list(rules), "check", "failed_rows")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def unique_check(df: DataFrame, code: str, *keys: str) -> DataFrame:
    return duplicate_keys(df, *keys).agg(F.lit(code).alias("check"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("failed_rows")).select("check", "failed_rows")


def monotonic_check(df: DataFrame, code: str, keys: list[str], order: str, session: str = "session") -> DataFrame:
    """Rows of a series whose session does not come after the one before it, in the order that they stand."""
    before = F.lag(session).over(Window.partitionBy(*keys).orderBy(order))
    wrong = F.col(session).isNull() | (F.col(session) <= before)
    return df.select(*keys, wrong.alias("__wrong")).agg(F.lit(code).alias("check"), F.count_if("__wrong").alias("failed_rows")).select("check", "failed_rows")


def one_value_check(df: DataFrame, code: str, keys: list[str], values: list[str]) -> DataFrame:
    """Series that have more than one value (missing counts as one) of some column."""
    told = df.groupBy(*keys).agg(*(F.count_distinct(F.coalesce(F.col(v).cast("string"), F.lit("\0"))).alias(v) for v in values))
    bad = F.lit(False)
    for v in values:
        bad = bad | (F.col(v) > 1)
    return told.agg(F.lit(code).alias("check"), F.count_if(bad).alias("failed_rows")).select("check", "failed_rows")


def alignment_check(grid: DataFrame, code: str = "MISALIGNED") -> DataFrame:
    """Securities that lack a session of the grid or have one twice."""
    days = grid.agg(F.count_distinct("session").alias("days"))
    n = grid.groupBy("security_id").agg(F.count("*").alias("n"), F.count_distinct("session").alias("d"))
    return n.join(F.broadcast(days)).agg(F.lit(code).alias("check"), F.count_if((F.col("n") != F.col("days")) | (F.col("d") != F.col("days"))).alias("failed_rows")).select("check", "failed_rows")


def reconciled(expected: DataFrame, found: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Expected values with MATCH, DIFFERENT or MISSING by what was found."""
    both = expected.join(found.select(*keys, F.col("value").alias("found")), keys, "left")
    return both.withColumn("status", F.when(F.col("found").isNull(), "MISSING").when(F.abs(F.col("found") - F.col("expected")) <= tolerance, "MATCH").otherwise("DIFFERENT"))


def assert_clean(checks: DataFrame) -> None:
    failed = checks.where("failed_rows > 0").orderBy("check").limit(20).collect()
    if failed:
        raise CheckFailed(", ".join(f"{r['check']} ({r['failed_rows']} rows)" for r in failed))


def no_look_ahead(panel: DataFrame, session: str = "session", known_at: str = "available_at") -> dict[str, Column]:
    return {"LOOK_AHEAD": F.col(known_at) <= F.col(session)}


def fingerprint(df: DataFrame) -> DataFrame:
    """Number of rows and an order-free fingerprint of all columns: the sum of each row's first 60 bits of MD5.

    Rows are their values as text in order of column names, NULL apart from empty. Equal rows count as often as they occur.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in sorted(df.columns)))
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(bits).cast("string").alias("fingerprint"))


def differences(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Rows that only one of two tables has, with how often."""
    a, b = a.drop(*ignored), b.drop(*ignored)
    return a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT")))


def prefix_invariant(panel: DataFrame, run, cut, digits: int = 9) -> DataFrame:
    """Rows up to ``cut`` that change if the panel ends there, or if what comes after is changed; empty where no operator looks ahead."""
    def known(df: DataFrame) -> DataFrame:
        out = run(df).where(F.col("session") <= cut)
        return out.select("session", "security_id", *(F.round(F.col(c), digits).alias(c) for c in out.columns if c not in ("session", "security_id")))

    whole = known(panel)
    numbers = [f.name for f in panel.schema if f.dataType.typeName() == "double"]
    changed = panel.withColumns({c: F.when(F.col("session") > cut, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in numbers})
    return whole.exceptAll(known(panel.where(F.col("session") <= cut))).unionByName(whole.exceptAll(known(changed)))


def neutral_check(panel: DataFrame, value: str, group: list[str], most: float = 1e-9) -> DataFrame:
    means = panel.where(F.col(value).isNotNull()).groupBy(*group).agg(F.avg(value).alias("m"))
    return means.agg(F.lit("NOT_NEUTRAL").alias("check"), F.count_if(F.abs("m") > most).alias("failed_rows")).select("check", "failed_rows")


#: Fixed by contract: what looks like a credential in a text.
SECRET = r"""(?i)(?:api[_-]?key|secret|password|passwd|authorization|bearer|token)\s*[:=]\s*["']?[^\s,"']{8,}"""


def secret_like(df: DataFrame, pattern: str = SECRET) -> DataFrame:
    """Rows of any text column that look like a credential, by column."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    one = df.agg(*(F.count_if(F.coalesce(F.col(f"`{c}`").rlike(pattern), F.lit(False))).alias(c) for c in text))
    return one.unpivot([], text, "check", "failed_rows")


def maturity(rows: DataFrame) -> Column:
    """Evidence level E0 to E4 from flags."""
    return F.when(~F.col("computed"), "E0").when(~F.col("backtested"), "E1").when(~F.col("held_out"), "E2").when(~F.col("traded"), "E3").otherwise("E4")


def expected_facts(expected: DataFrame, versions: DataFrame, ledger: DataFrame, required: DataFrame, identity: list[str], near: float = 1e-9, parts: int | None = None) -> DataFrame:
    """Expected facts with status and reason, and a failed row for each required (security_id, field) that nobody expected.

    ``expected``: security_id, field, the identity columns, value, available_at, source, review_status and review_reason;
    ``versions``: the same without the review; ``ledger``: the sources that were verified. A match is exact on all identity
    columns and must be the only one; then value and time are compared. Reviews come first: PENDING and BLOCKED ones are
    not checked (a block needs a reason), UNMAPPED ones pass only where no version of the security has the field. ``parts`` is
    the number of tasks that facts are dealt to, Spark's own if None.
    """
    key = ["security_id", "field", *identity]
    dealt = lambda df, by: df if parts is None else df.repartition(parts, *by)
    expected, versions = dealt(expected, key), dealt(versions, key)
    one = versions.groupBy(*key).agg(F.count("*").alias("__n"), F.min("value").alias("__value"), F.min("available_at").alias("__at"))
    mapped = versions.select("security_id", "field").distinct().withColumn("__mapped", F.lit(True))
    known = ledger.select("source").distinct().withColumn("__known", F.lit(True))
    rows = dealt(expected.join(one, key, "left"), ["security_id", "field"]).join(mapped, ["security_id", "field"], "left").join(known, "source", "left")
    incomplete = F.lit(False)
    for c in (*key, "value", "available_at", "source"):
        incomplete = incomplete | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    same = (F.abs(F.col("__value") - F.col("value")) <= near * F.greatest(F.abs("__value"), F.abs("value"))) & (F.col("__at") == F.col("available_at"))
    review, reason = F.col("review_status"), F.trim(F.coalesce("review_reason", F.lit("")))
    told = lambda status, why: F.struct(F.lit(status).alias("status"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    verdict = (
        F.when(review == "PENDING", told("BLOCKED", "EXPECTATION_PENDING_REVIEW"))
        .when((review == "BLOCKED") & (reason == ""), told("FAIL", "BLOCK_EVIDENCE_INCOMPLETE")).when(review == "BLOCKED", told("BLOCKED", reason))
        .when((review == "UNMAPPED") & F.col("__mapped"), told("FAIL", "CANONICAL_FIELD_EXISTS")).when(review == "UNMAPPED", told("UNMAPPED", "NO_APPROVED_CANONICAL_TAG"))
        .when(~F.coalesce(review == "REVIEWED", F.lit(False)), told("FAIL", "MANUAL_REVIEW_STATUS_INVALID")).when(incomplete, told("FAIL", "EXPECTATION_INCOMPLETE")).when(F.col("__known").isNull(), told("FAIL", "EXPECTED_RAW_HASH_NOT_IN_VERIFIED_LEDGER"))
        .when(F.coalesce("__n", F.lit(0)) == 0, told("FAIL", "FACT_NOT_FOUND")).when(F.col("__n") > 1, told("FAIL", "FACT_MATCH_NOT_UNIQUE")).when(~F.coalesce(same, F.lit(False)), told("FAIL", "VALUE_TIME_OR_LINEAGE_MISMATCH")).otherwise(told("PASS", ""))
    )
    checked = rows.select(*key, verdict.alias("v")).select(*key, "v.*")
    there = expected.groupBy("security_id", "field").agg(F.lit(True).alias("__there"))
    issuers = expected.select("security_id").distinct().withColumn("__issuer", F.lit(True))
    absent = required.join(there, ["security_id", "field"], "left").where("__there is null").join(issuers, "security_id", "left")
    missing = absent.select("security_id", "field", F.lit("FAIL").alias("status"), F.when(F.col("__issuer").isNull(), "REQUIRED_ISSUER_MISSING").otherwise("REQUIRED_FIELD_CHECK_MISSING").alias("reason"))
    return checked.unionByName(missing, allowMissingColumns=True)
