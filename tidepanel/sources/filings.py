"""Nested filing documents as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.operators.asof import next_at

OBSERVATION = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS = f"struct<cik:bigint,entityName:string,facts:map<string,map<string,struct<label:string,description:string,units:map<string,array<{OBSERVATION}>>>>>>"
SUBMISSIONS = "struct<cik:string,tickers:array<string>,exchanges:array<string>,filings:struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,form:array<string>,reportDate:array<string>>>>"


def company_facts(documents: DataFrame, column: str = "json", forms: tuple[str, ...] = ("10-K", "10-Q", "10-K/A", "10-Q/A")) -> DataFrame:
    """One row for each observation of a facts document, with its place in its list; other forms are left out."""
    rows = documents.select(F.from_json(column, FACTS).alias("d")).select(sc.padded_id(F.col("d.cik")).alias("issuer"), F.explode("d.facts").alias("namespace", "tags"))
    rows = rows.select("issuer", "namespace", F.explode("tags").alias("tag", "body")).select("issuer", "namespace", "tag", F.explode("body.units").alias("unit", "all"))
    rows = rows.select("issuer", "namespace", "tag", "unit", F.posexplode("all").alias("source_index", "o")).where(F.col("o.form").isin(*forms))
    out = rows.select("issuer", "namespace", "tag", sc.plain_unit(F.col("unit")).alias("unit"), "source_index", F.to_date("o.start").alias("period_start"), F.to_date("o.end").alias("period_end"), F.col("o.val").alias("value"),
        F.col("o.accn").alias("accession"), F.col("o.fy").alias("fiscal_year"), F.col("o.fp").alias("fiscal_period"), F.col("o.form").alias("form"), F.to_date("o.filed").alias("filed"))
    return out.withColumn("source_id", sc.identity(*(F.col(c) for c in ("issuer", "namespace", "tag", "unit", "period_start", "period_end", "accession", "value"))))


def accessions(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row for each accession of submissions documents: EXACT, DATE_ONLY or CONFLICT by its acceptance times."""
    r = F.col("d.filings.recent")
    rows = documents.select(F.from_json(column, SUBMISSIONS).alias("d")).select(sc.padded_id(F.col("d.cik")).alias("issuer"), F.explode(F.arrays_zip(r["accessionNumber"].alias("accession"), r["filingDate"].alias("filed"), r["acceptanceDateTime"].alias("accepted"), r["form"].alias("form"))).alias("x"))
    rows = rows.select("issuer", "x.*").withColumn("accepted", sc.acceptance(F.col("accepted")))
    out = rows.groupBy("issuer", "accession").agg(F.max("filed").alias("filed"), F.collect_set("accepted").alias("times"), F.max("form").alias("form"))
    status = F.when(F.size("times") == 1, "EXACT").when(F.size("times") == 0, "DATE_ONLY").otherwise("CONFLICT")
    return out.select("issuer", "accession", F.to_date("filed").alias("filed"), F.when(F.size("times") == 1, F.element_at("times", 1)).alias("accepted"), "form", status.alias("status"))


def ticker_index(documents: DataFrame, column: str = "json") -> DataFrame:
    """Rows of a document ``{fields: [...], data: [[...]]}``, each as a map of lower-case field names."""
    d = documents.select(F.from_json(column, "struct<fields:array<string>,data:array<array<string>>>").alias("d"))
    fields = F.transform("d.fields", lambda f: F.lower(F.trim(f)))
    return d.select(fields.alias("fields"), F.explode("d.data").alias("row")).select(F.map_from_arrays("fields", "row").alias("row"))


def historical_availability(facts: DataFrame, index: DataFrame, calendar: DataFrame) -> DataFrame:
    """Facts with the time from which they could be known: acceptance and ten minutes, else the next session's close.

    The next session is the first after the day of filing, within two weeks. ``calendar`` has session and close_at and is a
    dimension of a few thousand rows; the days of filing are looked up in it once each.
    """
    days = facts.select("filed").where("filed is not null").distinct().withColumn("k", F.lit(1))
    found = next_at(calendar.select("session", F.lit(1).alias("k")), days, ["k"], "session", "filed")
    after = found.where(F.col("next_session") <= F.date_add("filed", 14)).select("filed", F.col("next_session").alias("session")).join(F.broadcast(calendar.select("session", "close_at")), "session").select("filed", "close_at")
    rows = facts.join(index.select("issuer", "accession", "accepted"), ["issuer", "accession"], "left").join(F.broadcast(after), "filed", "left")
    known = F.coalesce(F.col("accepted") + F.expr("interval 10 minutes"), F.col("close_at").cast("timestamp"))
    precision = F.when(F.col("accepted").isNotNull(), "EXACT").when(F.col("close_at").isNotNull(), "NEXT_SESSION").otherwise("UNKNOWN")
    return rows.withColumns({"historical_available_at": known, "precision": precision}).drop("close_at")


def latest_artifacts(ledger: DataFrame, cutoff) -> DataFrame:
    """Of each (issuer, kind, url) the last artefact that was asked for and seen by the cutoff."""
    seen = ledger.where((F.col("requested_at") <= cutoff) & (F.col("first_seen_at") <= cutoff))
    return seen.groupBy("issuer", "kind", "url").agg(F.max(F.struct("requested_at", "sha", "first_seen_at")).alias("a")).select("issuer", "kind", "url", "a.*")


def bars_from_json(spark: SparkSession, path: str, symbol: str = r"/([^/.]+)\.json$") -> DataFrame:
    """Arrays of bars, a file for each symbol, whose name is the symbol; or what ``symbol``, a pattern, finds in the file's path."""
    rows = spark.read.schema("date string, open double, high double, low double, close double, volume double").json(path, multiLine=True)
    return rows.select(F.to_date("date").alias("session"), F.regexp_extract(F.col("_metadata.file_path"), symbol, 1).alias("security_id"), "open", "high", "low", "close", "volume")


def bars_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of bars of many symbols in each file, a line ``{"symbol": ..., "bars": [...]}`` for each."""
    bar = "struct<date:string,open:double,high:double,low:double,close:double,volume:double>"
    rows = spark.read.schema(f"symbol string, bars array<{bar}>").json(path).select("symbol", F.explode("bars").alias("b"))
    return rows.select(F.to_date("b.date").alias("session"), F.col("symbol").alias("security_id"), *(F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))


def strings_from_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV file with a header, all columns text."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def overlaid(batches: DataFrame, keys: list[str], values: list[str], round_col: str = "round") -> DataFrame:
    """Of each key and value the one of the last round that has it."""
    return batches.groupBy(*keys).agg(*(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(round_col))).alias(v) for v in values))
