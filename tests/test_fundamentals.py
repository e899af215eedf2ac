"""Quarters, trailing years, derived fields, filings and sinks on small cases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc
from tidepanel.operators import accounts, asof
from tidepanel.operators.fundamentals import derived, periods
from tidepanel.sources import filings, panels, sinks

FACT = "security_id string, field string, unit string, fiscal_year int, fiscal_period string, period_start date, period_end date, available_at date, accession string, source_id string, value double"


def fact(period, end, available, value, source, year=2024):
    return ("s", "revenue", "usd", year, period, dt.date(year, 1, 1), dt.date.fromisoformat(end), dt.date.fromisoformat(available), source, source, float(value))


YEAR = [fact("Q1", "2024-03-31", "2024-05-01", 10, "q1"), fact("Q2", "2024-06-30", "2024-08-01", 25, "h1"), fact("Q3", "2024-09-30", "2024-11-01", 40, "m9"), fact("FY", "2024-12-31", "2025-02-15", 60, "fy")]


def test_quarters_and_restatement(spark):
    df = spark.createDataFrame([*YEAR, fact("FY", "2024-12-31", "2025-03-15", 62, "fy2")], FACT)
    q = periods.quarters(df)
    rows = sorted((r["quarter"], str(r["available_at"]), r["value"]) for r in q.collect())
    assert rows == [("Q1", "2024-05-01", 10), ("Q2", "2024-08-01", 15), ("Q3", "2024-11-01", 15), ("Q4", "2025-02-15", 20), ("Q4", "2025-03-15", 22)]
    ttm = sorted((str(r["available_at"]), r["value"]) for r in periods.trailing_year(q).collect())
    assert ttm == [("2025-02-15", 60), ("2025-03-15", 62)]
    assert {r["basis"] for r in periods.by_basis(df).select("basis").distinct().collect()} == {"RAW", "ANNUAL", "QUARTERLY_DISCRETE", "TTM"}


def test_equal_lengths_and_gaps_are_left_out(spark):
    q = periods.quarters(spark.createDataFrame([YEAR[0], fact("Q2", "2024-03-31", "2024-08-01", 25, "h1"), YEAR[3]], FACT))
    assert [r["quarter"] for r in q.collect()] == ["Q1"]


def test_annual_proxy(spark):
    df = spark.createDataFrame([*YEAR, fact("FY", "2023-12-31", "2024-02-15", 50, "old", 2023)], FACT)
    left = periods.annual_proxy(df, periods.trailing_year(periods.quarters(df))).collect()
    assert [r["source_id"] for r in left] == ["old"]


FACTS = "security_id string, field string, value double, unit string, semantic_grade string, sign_convention string, dimensions string, fiscal_year int, fiscal_period string, period_end string, available_at string, source_id string"


def version(field, value, year=2024, end=None, unit="usd", grade="SOURCE_LINKED_DIRECT", sign=None, dims=None, known=None, source=None):
    return ("s", field, value, unit, grade, sign, dims, year, "FY", end or f"{year}-12-31", known or f"{year + 1}-03-01", source or f"{field}-{year}")


DEBT = [version("short_term_debt", 5.0), version("long_term_debt_current", 7.0), version("long_term_debt_noncurrent", 1.0)]
CASH_FLOW = [version("operating_cash_flow", 9.0)]


DERIVED = [
    ("total_debt", DEBT, None, 13.0),
    ("total_debt", DEBT[:2], "MISSING_INPUT", None),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", -1.0)], "NEGATIVE_DEBT_INPUT", None),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", -1.0, sign="POSITIVE_OBLIGATION")], None, 13.0),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", 1.0, end="2024-12-30")], "INPUT_PERIOD_MISMATCH", None),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", 1.0, unit="eur")], "INPUT_CURRENCY_MISMATCH", None),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", 1.0, dims="x")], "INPUT_CONTEXT_MISMATCH", None),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", 1.0, grade="GUESS")], "INPUT_SEMANTIC_GRADE_UNAPPROVED", None),
    ("total_debt", [*DEBT[:2], version("long_term_debt_noncurrent", 1.0, grade="HYPOTHESIS_PROXY")], "INPUT_SEMANTIC_GRADE_INCOMPATIBLE", None),
    ("free_cash_flow", [*CASH_FLOW, version("capital_expenditure", -2.0, sign="POSITIVE_OUTFLOW")], None, 7.0),
    ("free_cash_flow", [*CASH_FLOW, version("capital_expenditure", 2.0)], "INPUT_SIGN_CONVENTION_UNAPPROVED", None),
    ("roa", [version("net_income", 6.0), version("total_assets", 30.0), version("total_assets", 10.0, 2023)], None, 0.3),
    ("roa", [version("net_income", 6.0), version("total_assets", 30.0), version("total_assets", 10.0, 2022)], "PRIOR_FISCAL_YEAR_MISSING", None),
    ("roa", [version("net_income", 6.0), version("total_assets", 30.0), version("total_assets", 10.0, 2023, end="2023-12-30")], "PRIOR_FISCAL_ANCHOR_MISMATCH", None),
    ("roe", [version("net_income", 6.0), version("stockholders_equity", 3.0), version("stockholders_equity", -9.0, 2023)], "NON_POSITIVE_DENOMINATOR", None),
    ("inventory_turnover", [version("revenue", 9.0), version("gross_profit", 3.0), version("inventory", 2.0), version("inventory", 4.0, 2023)], None, 2.0),
    ("asset_growth", [version("total_assets", 30.0), version("total_assets", 10.0, 2023)], None, 2.0),
    ("ebitda", [version("net_income", 1.0), version("income_tax_expense", -2.0, sign="POSITIVE_EXPENSE"), version("interest_expense", 3.0), version("depreciation_and_amortization", 4.0)], None, 10.0),
    ("book_value_per_share", [version("stockholders_equity", 30.0), version("shares_outstanding_sec", 0.0, unit="shares")], "NON_POSITIVE_DENOMINATOR", None),
]


def test_derived_reasons(spark):
    rows = [(str(k), *r[1:]) for k, (_, rs, *_) in enumerate(DERIVED) for r in rs]
    v = spark.createDataFrame(rows, FACTS).withColumns({c: F.to_date(c) for c in ("period_end", "available_at")})
    said = {(r["security_id"], r["field"]): (r["reason"], r["value"]) for r in derived.derive(v).where("at = date'2025-03-01'").collect()}
    for k, (field, _, reason, value) in enumerate(DERIVED):
        assert said[str(k), field] == (reason, None if value is None else pytest.approx(value)), (k, field)


def test_price_proxies(spark):
    v = spark.createDataFrame([*DEBT, version("shares_outstanding_sec", 10.0, unit="shares"), version("cash_and_cash_equivalents", 3.0)], FACTS).withColumns({c: F.to_date(c) for c in ("period_end", "available_at")})
    prices = spark.createDataFrame([("s", "2025-02-01", 2.0, "usd"), ("s", "2025-03-05", 2.0, "usd"), ("s", "2025-03-06", 0.0, "usd"), ("s", "2025-03-07", 3.0, "eur"), ("s", "2025-03-08", 3.0, None)], "security_id string, at string, raw_close double, currency string").withColumn("at", F.to_date("at"))
    said = {(str(r["at"]), r["field"][:3]): (r["reason"], r["value"], r["unit"]) for r in derived.derive(v, prices).where("field like '%proxy'").collect()}
    assert said["2025-02-01", "mar"][0] == "MISSING_INPUT" and said["2025-03-05", "mar"] == (None, 20.0, "usd") and said["2025-03-05", "ent"] == (None, 30.0, "usd")
    assert said["2025-03-06", "mar"][0] == "NON_POSITIVE_PRICE" and said["2025-03-07", "mar"][1:] == (30.0, "eur") and said["2025-03-07", "ent"][0] == "INPUT_CURRENCY_MISMATCH" and said["2025-03-08", "mar"][0] == "PRICE_CURRENCY_MISSING"


def test_yearly_growth(spark):
    rows = [("a", "r", "Q1", 2023, "2023-03-31", 10.0), ("a", "r", "Q1", 2024, "2024-03-31", 12.0), ("b", "r", "Q1", 2023, "2023-03-31", -1.0), ("b", "r", "Q1", 2024, "2024-03-31", 1.0), ("c", "r", "Q1", 2023, "2023-04-30", 5.0), ("c", "r", "Q1", 2024, "2024-03-31", 6.0)]
    df = spark.createDataFrame(rows, "security_id string, field string, fiscal_period string, fiscal_year int, period_end string, value double").withColumn("period_end", F.to_date("period_end"))
    said = {r["security_id"]: (r["reason"], r["growth"]) for r in derived.yearly_growth(df).where("fiscal_year = 2024").collect()}
    assert said["a"][1] == pytest.approx(0.2) and said["b"][0] == "NON_POSITIVE_DENOMINATOR" and said["c"][0] == "PRIOR_FISCAL_ANCHOR_MISMATCH"


def test_filings(spark):
    doc = {"cik": 320, "entityName": "x", "facts": {"us-gaap": {"Revenues": {"label": "l", "description": "d", "units": {"USD": [
        {"start": "2024-01-01", "end": "2024-03-31", "val": 5.0, "accn": "a1", "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01", "frame": None},
        {"start": "2024-01-01", "end": "2024-03-31", "val": 6.0, "accn": "a2", "fy": 2024, "fp": "Q1", "form": "8-K", "filed": "2024-05-02", "frame": None}]}}}}}
    facts = filings.company_facts(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    row = facts.collect()
    assert len(row) == 1 and (row[0]["issuer"], row[0]["value"], row[0]["unit"], row[0]["source_index"]) == ("0000000320", 5.0, "usd", 0)
    sub = {"cik": "320", "tickers": ["X"], "exchanges": ["N"], "filings": {"recent": {"accessionNumber": ["a1", "a2", "a3", "a3"], "filingDate": ["2024-05-01"] * 4, "acceptanceDateTime": ["2024-05-01T16:00:00Z", None, "20240501100000", "20240501110000"], "form": ["10-Q"] * 4, "reportDate": [None] * 4}}}
    index = filings.accessions(spark.createDataFrame([(json.dumps(sub),)], "json string"))
    assert {r["accession"]: r["status"] for r in index.collect()} == {"a1": "EXACT", "a2": "DATE_ONLY", "a3": "CONFLICT"}
    calendar = spark.createDataFrame([(dt.date(2024, 5, 2), dt.datetime(2024, 5, 2, 20))], "session date, close_at timestamp")
    got = filings.historical_availability(facts, index, calendar).first()
    assert got["precision"] == "EXACT" and got["historical_available_at"] == dt.datetime(2024, 5, 1, 16, 10)
    late = filings.historical_availability(facts.withColumn("accession", F.lit("a2")), index, calendar).first()
    assert late["precision"] == "NEXT_SESSION" and late["historical_available_at"] == dt.datetime(2024, 5, 2, 20)
    tickers = filings.ticker_index(spark.createDataFrame([(json.dumps({"fields": ["CIK", "Ticker"], "data": [["1", "A"], ["2", "B"]]}),)], "json string"))
    assert [r["row"]["ticker"] for r in tickers.collect()] == ["A", "B"]


def test_files(spark, tmp_path):
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars" / "AAPL.json").write_text(json.dumps([{"date": "2024-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 10}]))
    bars = filings.bars_from_json(spark, str(tmp_path / "bars"))
    assert (bars.first()["security_id"], bars.first()["close"]) == ("AAPL", 2.0)
    sinks.write_partitioned(bars, str(tmp_path / "out"), "security_id")
    assert spark.read.parquet(str(tmp_path / "out")).where("security_id = 'AAPL'").count() == 1
    with pytest.raises(Exception, match="exists"):
        sinks.write_partitioned(bars, str(tmp_path / "out"), "security_id")
    sinks.write_table(bars, str(tmp_path / "csv"), "csv")
    assert filings.strings_from_csv(spark, str(tmp_path / "csv"), tuple(bars.columns)).first()["close"] == "2.0"


def test_mapping_statuses(spark):
    c = spark.createDataFrame([("t", None, "usd", "2020-01-01", None, 1, "f"), ("u", None, "usd", "2020-01-01", None, 1, "g"), ("u", None, "usd", "2020-01-01", None, 1, "h"), ("v", None, "usd", "2025-01-01", None, 1, "k")], "tag string, issuer string, unit string, valid_from string, valid_to string, priority int, field string")
    facts = spark.createDataFrame([(1, "t", "i", "usd", "2024-01-01"), (2, "u", "i", "usd", "2024-01-01"), (3, "x", "i", "usd", "2024-01-01"), (4, "t", "i", "eur", "2024-01-01"), (5, "v", "i", "usd", "2024-01-01")], "fact_id int, tag string, issuer string, unit string, filed string")
    assert [r["status"] for r in asof.mapped(facts, c).orderBy("fact_id").collect()] == ["MAPPED", "DEFERRED_SEMANTIC_AMBIGUITY", "DEFERRED_CUSTOM_TAG", "DEFERRED_UNIT_OR_BASIS", "DEFERRED_SEMANTIC"]


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    assert accounts.one_to_one(a, b.limit(1), "k").count() == 1
    with pytest.raises(Exception, match="NOT_ONE_TO_ONE"):
        accounts.one_to_one(a, b, "k").collect()


def test_scalars(spark):
    df = spark.createDataFrame([("20240301210500", "brk-b"), ("2024-03-01T21:05:00Z", "aapl"), ("soon", " x ")], "t string, k string")
    rows = df.select(sc.acceptance(F.col("t")).alias("t"), sc.dotted_ticker(F.col("k")).alias("k"), sc.class_suffix(F.upper("k")).alias("c")).collect()
    assert rows[0]["t"] == rows[1]["t"] and rows[2]["t"] is None and [r["k"] for r in rows] == ["BRK.B", "AAPL", "X"] and [r["c"] for r in rows] == ["B", None, None]


def test_streams(spark, tmp_path):
    from tidepanel import streaming

    schema = "event_id long, ts timestamp, user_id long, value double, fill_id long, available_at timestamp"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, at(1, 9), 7, 3.0, 1, at(1, 9)), (2, at(1, 15), 7, 5.0, 1, at(1, 18)), (3, at(1, 12), 7, 1.0, 2, at(2, 9)), (4, at(5, 9), 7, 9.0, 3, at(2, 19))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    bars = drained(streaming.stream_bars(source()), "bars")
    first = next(r for r in bars if r["session"] == dt.date(2024, 1, 1))
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (3.0, 5.0, 1.0, 5.0, 3)
    assert len(drained(streaming.stream_fills(source()), "fills")) == 3
    calendar = spark.createDataFrame([(dt.date(2024, 1, 1), at(1, 16), dt.date(2024, 1, 2)), (dt.date(2024, 1, 2), at(2, 16), dt.date(2024, 1, 3))], "day date, close_at timestamp, next_session date")
    routed = {r["event_id"]: r["usable_session"].day for r in drained(streaming.route_late(source(), calendar), "routed")}
    assert routed == {1: 1, 2: 2, 3: 2, 4: 3}


def test_grid_keeps_sessions(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (3, "b", 2.0)], "session int, security_id string, close double")
    assert panels.densify(rows).count() == 4
