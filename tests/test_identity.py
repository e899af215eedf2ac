"""Resolution of securities, identity rows at cutoffs against a plain loop, portfolios in one plan."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidepanel.operators import identity as idn
from tidepanel.operators import portfolio as pf
from tidepanel.operators import selection as sel

DAY = dt.date(2024, 1, 1)
UNIVERSE = "security_id string, ticker string, exchange string, security_type string, domicile string, name string, is_adr boolean, effective_from date, effective_to date"
INDEX = "issuer long, sec_ticker string, sec_exchange string, position int, forms array<string>"


def day(n):
    return DAY + dt.timedelta(n)


def test_every_status(spark):
    good = ("COMMON_STOCK", "US", "Plain Inc", False, DAY, None)
    rows = [
        ("single", "brk.b", "New York  stock exchange", *good), ("entity", "TWO", "NASDAQ", *good), ("blank", " ", "NYSE", *good), ("nowhere", "AAA", None, *good), ("unknown", "ZZZ", "NYSE", *good), ("conflict", "AAA", "NYSE", *good),
        ("several", "DUP", "NYSE ARCA", *good), ("etf", "AAA", "NASDAQ", "ETF", "US", "x", False, DAY, None), ("abroad", "FOR", "NYSE", "REIT", "Canada", "x", None, DAY, None), ("receipt", "AAA", "NASDAQ", "COMMON_STOCK", "", "Some ADR", False, DAY, None),
        ("one", "M", "NYSE", *good[:4], DAY, day(10)), ("other", "M-A", "NYSE", *good[:4], day(5), None), ("after", "M-C", "Cboe BZX", *good[:4], day(-9), DAY)]
    index = [(1, "BRK-B", "NYSE", 0, ["10-K"]), (2, "TWO", "Nasdaq Global Select", 0, []), (2, "TWO-A", "NYSE", 1, []), (3, "AAA", "NASDAQ", 0, None), (4, "DUP", "NYSEARCA", 0, []), (5, "DUP", "NYSE Arca", 0, []),
             (6, "FOR", "NYSE", 0, ["40-F", "20-F"]), (7, "M", "NYSE", 0, []), (7, "M-A", "NYSE", 1, []), (7, "M-C", "CBOEBZX", 2, [])]
    found = {r["security_id"]: (r["issuer"], r["mapping_status"], r["blocking_reasons"]) for r in idn.resolve(spark.createDataFrame(rows, UNIVERSE), spark.createDataFrame(index, INDEX)).collect()}
    several = "ISSUER_HAS_MULTIPLE_SEC_TICKERS"
    assert found == {
        "single": (1, "VERIFIED_SINGLE_CLASS", ""), "entity": (2, "VERIFIED_ENTITY_LEVEL_ONLY", several), "blank": (None, "UNRESOLVED", "MISSING_TICKER"), "nowhere": (None, "UNRESOLVED", "MISSING_EXCHANGE"), "unknown": (None, "UNRESOLVED", "TICKER_NOT_FOUND"),
        "conflict": (None, "UNRESOLVED", "EXCHANGE_CONFLICT"), "several": (None, "UNRESOLVED", "MULTIPLE_ISSUER_MATCHES"), "etf": (3, "DEFERRED_ISSUER_SCOPE", "UNSUPPORTED_SECURITY_TYPE:ETF"),
        "abroad": (6, "DEFERRED_ISSUER_SCOPE", "NON_US_DOMICILE:CANADA|FOREIGN_FILING_FORM:20-F|FOREIGN_FILING_FORM:40-F"), "receipt": (3, "DEFERRED_ISSUER_SCOPE", "MISSING_DOMICILE|ADR_EVIDENCE"),
        "one": (7, "AMBIGUOUS_MULTI_CLASS", f"{several}|MULTIPLE_PROJECT_SECURITIES_FOR_ISSUER"), "other": (7, "AMBIGUOUS_MULTI_CLASS", f"{several}|MULTIPLE_PROJECT_SECURITIES_FOR_ISSUER"), "after": (7, "VERIFIED_ENTITY_LEVEL_ONLY", several)}


def test_rows_at_cutoffs_against_loop(spark):
    rng = random.Random(4)
    history = [(s, day(a := rng.randrange(40)), rng.choice((None, day(a + rng.randrange(-2, 15)))), n) for n, s in enumerate(rng.randrange(5) for _ in range(60))]
    asked = [(rng.randrange(6), day(rng.randrange(-3, 60)), k) for k in range(300)]
    found = idn.at_cutoff(spark.createDataFrame(history, "security_id int, effective_from date, effective_to date, issuer int"), spark.createDataFrame(asked, "security_id int, cutoff date, k int"), ["issuer"])
    want = []
    for s, at, k in asked:
        own = [n for h, a, b, n in history if h == s and a <= at and (b is None or at < b)]
        want.append((k, len(own), own[0] if len(own) == 1 else None))
    assert sorted((r["k"], r["n_rows"], r["held_issuer"]) for r in found.collect()) == want


def test_usages(spark):
    history = spark.createDataFrame([(1, DAY, None, 7, idn.ENTITY), (2, DAY, None, 8, idn.SINGLE)], "security_id int, effective_from date, effective_to date, issuer int, mapping_status string")
    rows = [(1, 7, "statement", "OK"), (1, 7, "SHARES", "IDENTITY_NOT_USABLE"), (2, 8, "shares", "OK"), (2, 7, "SHARES", "IDENTITY_ISSUER_MISMATCH"), (2, 8, "x", "IDENTITY_UNKNOWN_USAGE"), (3, 8, "ENTITY", "IDENTITY_INTERVAL_COUNT")]
    asked = spark.createDataFrame([(s, DAY, i, u, want) for s, i, u, want in rows], "security_id int, cutoff date, issuer int, usage string, want string")
    assert all(r["status"] == r["want"] for r in idn.usable(history, asked).collect())


def test_portfolios_in_one_plan(spark):
    """Several portfolios together have the net values that each has alone; zero weights change nothing."""
    rng = random.Random(1)
    grid = spark.createDataFrame([(day(n), s, 10 + rng.random() * 5) for n in range(20) for s in range(6)], "session date, security_id int, close double")
    weights = spark.createDataFrame([(p, day(e), s, 0.95 / 3 if s % 2 == p % 2 else 0.0) for p in (1, 2) for e in range(p, 18, 4 + p) for s in range(6)], "p int, execution date, security_id int, weight double")
    both = sorted(tuple(r) for r in pf.cohort_nav(grid, weights, by=("p",)).collect())
    alone = sorted((p, *tuple(r)) for p in (1, 2) for r in pf.cohort_nav(grid, weights.where(F.col("p") == p).drop("p")).collect())
    assert [x[:2] for x in both] == [x[:2] for x in alone] and all(abs(a - b) < 1e-12 for x, y in zip(both, alone, strict=True) for a, b in zip(x[2:], y[2:], strict=True))


def test_composites(spark):
    shares = spark.createDataFrame([(f, DAY, s, v) for s, vs in ((1, (0.2, 0.4, 0.9)), (2, (0.5, None, 0.1))) for f, v in zip("abc", vs, strict=True)], "factor_id string, session date, security_id int, share double")
    ics = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", -0.2), ("c", None)], "factor_id string, ic double")
    found = {(r["composite_id"], r["security_id"]): r["score"] for r in sel.composites(shares, {"AB": ("a", "b"), "C": ("c",)}, sel.frozen_directions(ics)).collect()}
    assert found == {("AB", 1): (0.2 + 0.6) / 2, ("AB", 2): None, ("C", 1): 0.9, ("C", 2): 0.1}


def most_rows(df):
    """The most rows that any step of a plan gave out, after it ran."""
    df.collect()
    found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found = max(found, metric.get().value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_ticker_of_many_makes_no_pairs(spark):
    n = 400
    universe = spark.createDataFrame([(str(i), "T", "NYSE" if i % 2 else "NASDAQ", "REIT", "US", "x", False, DAY, None) for i in range(n)], UNIVERSE)
    index = spark.createDataFrame([(i, "T", "NYSE" if i else "NASDAQ", 0, []) for i in range(n)], INDEX)
    out = idn.resolve(universe, index)
    assert most_rows(out) <= 10 * n
    found = {r["security_id"]: (r["issuer"], r["blocking_reasons"]) for r in out.collect()}
    assert found == {str(i): (None, "MULTIPLE_ISSUER_MATCHES") if i % 2 else (0, "MULTIPLE_PROJECT_SECURITIES_FOR_ISSUER") for i in range(n)}
