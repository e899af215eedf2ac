"""Which issuer a security is of, and which row of an identity history holds at a time.

Issuers are looked up in an index keyed by normalised ticker; exchanges, scope and cardinality then decide, and every outcome
has a status and its reasons. Nothing is guessed: what is not found once is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.asof import overlapping

#: Fixed values of the contract: names of exchanges, types and domiciles in scope, forms of foreign filers, marks of depositary receipts, usages.
EXCHANGES = {
    "NASDAQ": "NASDAQ", "NASDAQ GLOBAL SELECT": "NASDAQ", "NASDAQ GLOBAL MARKET": "NASDAQ", "NASDAQ CAPITAL MARKET": "NASDAQ", "NYSE": "NYSE", "NEW YORK STOCK EXCHANGE": "NYSE",
    "NYSE ARCA": "NYSEARCA", "NYSEARCA": "NYSEARCA", "NYSE AMERICAN": "NYSEAMERICAN", "NYSEAMERICAN": "NYSEAMERICAN"}
TYPES = ("COMMON_STOCK", "REIT")
DOMICILES = ("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA")
FOREIGN_FORMS = ("20-F", "20-F/A", "40-F", "40-F/A")
RECEIPT_TYPES, RECEIPT_MARKS = ("ADR", "ADS"), ("AMERICAN DEPOSITARY", "DEPOSITARY RECEIPT", " ADR", " ADS")
ENTITY_USAGES = ("ENTITY", "ENTITY_LEVEL", "STATEMENT")
SHARE_USAGES = ("PER_SHARE", "SHARES", "SHARE_COUNT", "SHARES_OUTSTANDING", "MARKET_CAP", "ENTERPRISE_VALUE")
SINGLE, ENTITY = "VERIFIED_SINGLE_CLASS", "VERIFIED_ENTITY_LEVEL_ONLY"
_OPEN = "9999-12-31"


def _text(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def normal_ticker(ticker: Column) -> Column:
    """Upper case, a share class after a hyphen."""
    return F.regexp_replace(_text(ticker), "[.-]", "-")


def normal_exchange(exchange: Column) -> Column:
    """The one name of an exchange; unknown ones lose their spaces."""
    raw = F.regexp_replace(_text(exchange), r"\s+", " ")
    names = F.create_map(*(F.lit(x) for pair in EXCHANGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, raw), F.replace(raw, F.lit(" ")))


def share_class(ticker: Column) -> Column:
    """What follows the last full stop or hyphen, or NULL."""
    return F.nullif(F.regexp_extract(_text(ticker), "[.-]([A-Z0-9]+)$", 1), F.lit(""))


def scope_reasons(forms: Column) -> Column:
    """Reasons why a row (security_type, domicile, name, is_adr) is out of scope; ``forms`` are filings of issuers with its ticker."""
    kind, home, name = _text(F.col("security_type")), _text(F.col("domicile")), _text(F.col("name"))
    receipt = F.coalesce("is_adr", F.lit(False)) | kind.isin(*RECEIPT_TYPES)
    for mark in RECEIPT_MARKS:
        receipt = receipt | F.contains(name, F.lit(mark))
    or_missing = lambda x: F.when(x == "", "MISSING").otherwise(x)
    reasons = F.array_compact(F.array(
        F.when(~kind.isin(*TYPES), F.concat(F.lit("UNSUPPORTED_SECURITY_TYPE:"), or_missing(kind))),
        F.when(home == "", "MISSING_DOMICILE").when(~home.isin(*DOMICILES), F.concat(F.lit("NON_US_DOMICILE:"), home)),
        F.when(receipt, "ADR_EVIDENCE")))
    foreign = F.sort_array(F.array_intersect(forms, F.array(*map(F.lit, FOREIGN_FORMS))))
    return F.concat(reasons, F.transform(foreign, lambda f: F.concat(F.lit("FOREIGN_FILING_FORM:"), f)))


def resolve(universe: DataFrame, index: DataFrame) -> DataFrame:
    """The bridge from securities to issuers: (security_id, effective_from, effective_to, issuer, sec_ticker, share_class,
    mapping_status, blocking_reasons), one row for each of ``universe``.

    ``universe``: security_id, ticker, exchange, security_type, domicile, name, is_adr, effective_from, effective_to (NULL: open);
    a security's intervals don't overlap. ``index``: issuer, sec_ticker, sec_exchange, position and forms, a row for each
    ticker that an issuer lists. Securities of one issuer whose intervals overlap are AMBIGUOUS_MULTI_CLASS.

    The index is first added up by ticker and by ticker and exchange, which securities then look up: the work grows with both
    tables, not with their product. Overlaps are found in order of start, without pairs.
    """
    row = ["security_id", "effective_from"]
    listed = index.select("issuer", "sec_ticker", "position", "forms", normal_ticker(F.col("sec_ticker")).alias("nt"), normal_exchange(F.col("sec_exchange")).alias("ne")).where("nt != ''")
    many = listed.groupBy("issuer").agg(F.count_distinct("nt").alias("n_tickers"))
    listed = listed.join(many, "issuer").select("nt", F.col("ne").alias("listed_on"), F.struct("issuer", "position", "sec_ticker", "n_tickers").alias("entry"), "forms")
    asked = universe.withColumns({"nt": normal_ticker(F.col("ticker")), "ne": normal_exchange(F.col("exchange"))})
    # a ticker and a ticker at an exchange each have one row, however many list it: securities never meet the entries themselves
    of_ticker = listed.groupBy("nt").agg(F.count("*").alias("n_entries"), F.count_distinct("entry.issuer").alias("n_issuers"), F.min("entry").alias("any"), F.array_distinct(F.flatten(F.collect_set("forms"))).alias("forms"))
    of_place = listed.groupBy("nt", F.col("listed_on").alias("ne")).agg(F.count_distinct("entry.issuer").alias("n_here"), F.min("entry").alias("match"))
    rows = asked.join(of_ticker, "nt", "left").join(of_place, ["nt", "ne"], "left").fillna(0, ["n_entries", "n_issuers", "n_here"])
    rows = rows.withColumn("scope", scope_reasons(F.coalesce("forms", F.array().cast("array<string>"))))
    out = F.size("scope") > 0
    # out of scope, the issuer is still told where there is only one
    lineage = F.when(F.col("n_here") > 0, F.when(F.col("n_here") == 1, F.col("match"))).when(F.col("n_issuers") == 1, F.col("any"))
    reason = F.when(F.col("nt") == "", "MISSING_TICKER").when(F.col("ne") == "", "MISSING_EXCHANGE").when(F.col("n_entries") == 0, "TICKER_NOT_FOUND").when(F.col("n_here") == 0, "EXCHANGE_CONFLICT").when(F.col("n_here") > 1, "MULTIPLE_ISSUER_MATCHES")
    entry = F.when(out, lineage).when(reason.isNull(), F.col("match"))
    single = F.col("match.n_tickers") == 1
    status = F.when(out, "DEFERRED_ISSUER_SCOPE").when(reason.isNotNull(), "UNRESOLVED").when(single, SINGLE).otherwise(ENTITY)
    reasons = F.when(out, F.col("scope")).when(reason.isNotNull(), F.array(reason)).when(single, F.array().cast("array<string>")).otherwise(F.array(F.lit("ISSUER_HAS_MULTIPLE_SEC_TICKERS")))
    rows = rows.select(*row, "effective_to", entry["issuer"].alias("issuer"), entry["sec_ticker"].alias("sec_ticker"), F.when(entry.isNotNull(), share_class(entry["sec_ticker"])).alias("share_class"), status.alias("status"), reasons.alias("reasons"))
    eligible = rows.where(F.col("status").isin(SINGLE, ENTITY)).select(*row, "issuer", F.coalesce("effective_to", F.lit(_OPEN).cast(universe.schema["effective_from"].dataType)).alias("until"))
    meets = overlapping(eligible, "issuer", "security_id", "effective_from", "until").where("ambiguous").select(*row, F.lit(True).alias("ambiguous"))
    rows = rows.join(meets, row, "left")
    told = F.when(F.col("ambiguous"), F.array_append("reasons", F.lit("MULTIPLE_PROJECT_SECURITIES_FOR_ISSUER"))).otherwise(F.col("reasons"))
    return rows.select(*row, "effective_to", "issuer", "sec_ticker", "share_class", F.when(F.col("ambiguous"), "AMBIGUOUS_MULTI_CLASS").otherwise(F.col("status")).alias("mapping_status"), F.concat_ws("|", told).alias("blocking_reasons"))


def at_cutoff(history: DataFrame, asked: DataFrame, payload: list[str]) -> DataFrame:
    """``asked`` (security_id, cutoff, ...) with n_rows, how many rows of a history hold then (from <= cutoff < to), and the payload
    of the one that does, if it is only one.

    A security's starts, ends and cutoffs are one sequence: running sums of +1 and -1 count the rows that hold, and the same
    sums of row numbers name the row where it is alone. Intervals may overlap; there is no join by range.
    """
    kind = asked.schema["cutoff"].dataType
    rows = history.select("security_id", F.col("effective_from").cast(kind).alias("from"), F.col("effective_to").cast(kind).alias("to"), *payload)
    rows = rows.where(F.col("from").isNotNull() & (F.col("to").isNull() | (F.col("from") < F.col("to"))))
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("security_id").orderBy("from", "to", *payload)).cast("long"))
    edges = rows.select("security_id", F.col("from").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"), "no")
    edges = edges.unionByName(rows.where("to is not null").select("security_id", F.col("to").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), "no"))
    marks = asked.select("security_id", F.col("cutoff").alias("at"), F.lit(1).alias("kind"), F.struct(*asked.columns).alias("asked"))
    run = Window.partitionBy("security_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = edges.unionByName(marks, allowMissingColumns=True)
    both = both.withColumns({"n_rows": F.coalesce(F.sum("step").over(run), F.lit(0)), "no": F.sum(F.col("step") * F.col("no")).over(run)}).where("kind = 1")
    told = rows.select("security_id", "no", *(F.col(c).alias(f"held_{c}") for c in payload))
    out = both.withColumn("no", F.when(F.col("n_rows") == 1, F.col("no"))).select("security_id", "no", "asked", "n_rows").join(told, ["security_id", "no"], "left")
    return out.select("asked.*", "n_rows", *(F.col(f"held_{c}") for c in payload))


def usable(history: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (security_id, cutoff, issuer, usage, ...) with n_rows and status: OK, IDENTITY_INTERVAL_COUNT unless exactly one
    row of the bridge holds at the cutoff, IDENTITY_ISSUER_MISMATCH, IDENTITY_UNKNOWN_USAGE, or IDENTITY_NOT_USABLE where the
    row's status does not allow the usage: statements take an entity, shares need a single class."""
    out = at_cutoff(history, asked, ["issuer", "mapping_status"])
    usage = _text(F.col("usage"))
    allowed = (F.col("held_mapping_status") == SINGLE) | ((F.col("held_mapping_status") == ENTITY) & usage.isin(*ENTITY_USAGES))
    status = F.when(~usage.isin(*ENTITY_USAGES, *SHARE_USAGES), "IDENTITY_UNKNOWN_USAGE").when(F.col("n_rows") != 1, "IDENTITY_INTERVAL_COUNT").when(~F.col("held_issuer").eqNullSafe(F.col("issuer")), "IDENTITY_ISSUER_MISMATCH").when(~F.coalesce(allowed, F.lit(False)), "IDENTITY_NOT_USABLE").otherwise("OK")
    return out.withColumn("status", status)
