"""All derived fields over facts of suppliers, made from their line items by year."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.fundamentals import derived
from tidepanel.plans.registry import query, rounded
from tidepanel.sources.panels import read, tasks

#: Yearly sums of a supplier's line items, as whole numbers; the same text in both dialects.
_SUMS = {"p": "sum(l_extendedprice)", "d": "sum(l_extendedprice * l_discount)", "t": "sum(l_extendedprice * l_tax)", "q": "sum(l_quantity)", "r": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END)"}
_USD, _LINKED, _END, _MARCH = "'usd'", "'SOURCE_LINKED_DIRECT'", "make_date(fy, 12, 31)", "make_date(fy + 1, 3, 1)"
_NONE = "CAST(NULL AS STRING)"
#: field: value, unit, sign convention, grade, dimensions, end of period, availability. Some break a rule on purpose.
_FACTS = {
    "revenue": ("p", _USD, _NONE, _LINKED, _NONE, _END, _MARCH),
    "gross_profit": ("p - d", _USD, _NONE, "CASE WHEN fy % 4 = 1 THEN 'HYPOTHESIS_PROXY' ELSE 'SOURCE_LINKED_DIRECT' END", _NONE, _END, _MARCH),
    "net_income": ("t - d / 2", _USD, _NONE, _LINKED, _NONE, _END, _MARCH),
    "income_tax_expense": ("CASE WHEN security_id % 2 = 0 THEN -t ELSE t END", _USD, "'POSITIVE_EXPENSE'", _LINKED, _NONE, _END, _MARCH),
    "interest_expense": ("d", _USD, "'POSITIVE_EXPENSE'", _LINKED, _NONE, _END, _MARCH),
    "depreciation_and_amortization": ("q", _USD, "'POSITIVE_ADD_BACK'", _LINKED, _NONE, _END, _MARCH),
    "operating_cash_flow": ("p - r", _USD, _NONE, _LINKED, _NONE, _END, _MARCH),
    "capital_expenditure": ("-q * 10", _USD, "CASE WHEN fy % 5 = 0 THEN 'SIGNED' ELSE 'POSITIVE_OUTFLOW' END", _LINKED, _NONE, _END, _MARCH),
    "total_assets": ("p + q", _USD, _NONE, _LINKED, _NONE, _END, _MARCH),
    "stockholders_equity": ("p - 3 * r", _USD, _NONE, _LINKED, "CASE WHEN fy % 6 = 0 THEN 'segment:x' ELSE CAST(NULL AS STRING) END", _END, _MARCH),
    "inventory": ("CASE WHEN n % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE q END", _USD, _NONE, _LINKED, _NONE, "CASE WHEN fy % 3 = 0 THEN make_date(fy, 12, 30) ELSE make_date(fy, 12, 31) END", _MARCH),
    "current_assets": ("q * 100", _USD, _NONE, _LINKED, _NONE, _END, _MARCH),
    "current_liabilities": ("r", "CASE WHEN security_id % 10 = 0 THEN 'eur' ELSE 'usd' END", _NONE, _LINKED, _NONE, _END, _MARCH),
    "short_term_debt": ("d", _USD, "'POSITIVE_OBLIGATION'", _LINKED, _NONE, _END, _MARCH),
    "long_term_debt_current": ("t - q * 48", _USD, "CASE WHEN security_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'POSITIVE_OBLIGATION' END", _LINKED, _NONE, _END, _MARCH),
    "long_term_debt_noncurrent": ("r", _USD, "'POSITIVE_OBLIGATION'", _LINKED, _NONE, _END, _MARCH),
    "cash_and_cash_equivalents": ("t", _USD, _NONE, "CASE WHEN security_id % 7 = 0 THEN 'UNREVIEWED' ELSE 'SOURCE_LINKED_DIRECT' END", _NONE, _END, _MARCH),
    "shares_outstanding_sec": ("q - 25 * n", "'shares'", _NONE, _LINKED, _NONE, _END, "make_date(fy + 1, 2, 1)"),
}
#: Fields that are said again in June, by suppliers whose number three divides.
_RESTATED = ("revenue", "net_income", "total_assets")
_CURRENCY = "CASE WHEN security_id % 9 = 0 THEN CAST(NULL AS STRING) WHEN security_id % 8 = 0 THEN 'eur' ELSE 'usd' END"


def fact_versions(spark, sf_dir) -> DataFrame:
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), F.year("l_shipdate").alias("fy")).agg(F.count("*").alias("n"), *(F.expr(f"CAST(floor({x} + 0.00001) AS DOUBLE)").alias(k) for k, x in _SUMS.items()))
    names = ("value", "unit", "sign_convention", "semantic_grade", "dimensions", "period_end", "available_at")
    row = lambda f, value, known, again: F.struct(F.lit(f).alias("field"), *(F.expr(x).alias(k) for k, x in zip(names, (value, *_FACTS[f][1:6], known), strict=True)), F.lit(again).alias("again"))
    first = F.array(*(row(f, f"CAST({x[0]} AS DOUBLE)", x[6], 0) for f, x in _FACTS.items()))
    later = F.array(*(row(f, f"CAST({_FACTS[f][0]} + 10 AS DOUBLE)", "make_date(fy + 1, 6, 1)", 1) for f in _RESTATED))
    rows = sums.select("security_id", "fy", F.explode(F.when(F.col("security_id") % 3 == 0, F.concat(first, later)).otherwise(first)).alias("f")).select("security_id", F.col("fy").alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), "f.*")
    return rows.withColumn("source_id", F.concat_ws("-", "field", "fiscal_year", "again")).drop("again")


def month_closes(spark, sf_dir) -> DataFrame:
    """Each month's last price in whole units, so that products of prices and shares are exact."""
    li = read(spark, sf_dir, "lineitem")
    li = li.repartition(tasks(li), "l_suppkey")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    out = li.groupBy(F.col("l_suppkey").alias("security_id"), F.last_day("l_shipdate").alias("at")).agg(F.max_by(F.floor(F.try_divide("l_extendedprice", "l_quantity")).cast("double"), order).alias("raw_close"))
    return out.withColumn("currency", F.expr(_CURRENCY))


def derived_fields(spark, sf_dir) -> DataFrame:
    """All derived fields, with as many tasks as the line items ask for."""
    parts = tasks(read(spark, sf_dir, "lineitem"))
    return derived.derive(fact_versions(spark, sf_dir), month_closes(spark, sf_dir), parts)


def _dialect(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


_SQL_ROWS = " UNION ALL ".join(
    _dialect(f"SELECT security_id, fy AS fiscal_year, '{f}' AS field, CAST({x[0]}{plus} AS DOUBLE) AS v, {x[1]} AS u, {x[2]} AS s, {x[3]} AS g, {x[4]} AS d, {x[5]} AS p, {known} AS a, '{f}-' || fy || '-{again}' AS id FROM base {where}")
    for f, x in _FACTS.items() for again, plus, known, where in [(0, "", x[6], ""), *([(1, " + 10", "make_date(fy + 1, 6, 1)", "WHERE security_id % 3 = 0")] if f in _RESTATED else [])])
#: name: inputs, inputs of the year before, whether proxies may go in, formula, tests of the result; x is now, y a year before.
_D = ("short_term_debt", "long_term_debt_current", "long_term_debt_noncurrent")
_SQL_DEFINITIONS = {
    "total_debt": (_D, (), False, "{x0} + {x1} + {x2}", [("NEGATIVE_DEBT_INPUT", "least({x0}, {x1}, {x2}) < 0")]),
    "working_capital": (("current_assets", "current_liabilities"), (), False, "{x0} - {x1}", []),
    "free_cash_flow": (("operating_cash_flow", "capital_expenditure"), (), False, "{x0} - {x1}", []),
    "ebit": (("net_income", "income_tax_expense", "interest_expense"), (), False, "{x0} + {x1} + {x2}", []),
    "roa": (("net_income", "total_assets"), ("total_assets",), False, "{x0} / nullif(({x1} + {y0}) / 2, 0)", [("NON_POSITIVE_DENOMINATOR", "({x1} + {y0}) / 2 <= 0")]),
    "roe": (("net_income", "stockholders_equity"), ("stockholders_equity",), False, "{x0} / nullif(({x1} + {y0}) / 2, 0)", [("NON_POSITIVE_DENOMINATOR", "({x1} + {y0}) / 2 <= 0")]),
    "inventory_turnover": (("revenue", "gross_profit", "inventory"), ("inventory",), False, "({x0} - {x1}) / nullif(({x2} + {y0}) / 2, 0)", [("NON_POSITIVE_DENOMINATOR", "({x2} + {y0}) / 2 <= 0")]),
    "asset_growth": (("total_assets",), ("total_assets",), False, "{x0} / nullif({y0}, 0) - 1", [("NON_POSITIVE_DENOMINATOR", "{y0} <= 0")]),
    "revenue_growth": (("revenue",), ("revenue",), False, "{x0} / nullif({y0}, 0) - 1", [("NON_POSITIVE_DENOMINATOR", "{y0} <= 0")]),
    "book_value_per_share": (("stockholders_equity", "shares_outstanding_sec"), (), True, "{x0} / nullif({x1}, 0)", [("NON_POSITIVE_DENOMINATOR", "{x1} <= 0")]),
    "market_cap_sec_proxy": (("shares_outstanding_sec",), (), True, "{x0} * raw_close", [("NON_POSITIVE_PRICE", "raw_close <= 0"), ("NON_POSITIVE_INPUT", "{x0} <= 0")]),
    "ebitda": (("ebit", "depreciation_and_amortization"), (), False, "{x0} + {x1}", []),
    "enterprise_value_sec_proxy": (("market_cap_sec_proxy", "total_debt", "cash_and_cash_equivalents"), (), True, "{x0} + {x1} - {x2}", []),
}
_DAILY = ("market_cap_sec_proxy", "enterprise_value_sec_proxy")


def _sql_field(name: str, source: str) -> str:
    inputs, prior, proxies, formula, tests = _SQL_DEFINITIONS[name]
    now, then = [f"n_{i}" for i in inputs], [f"t_{i}" for i in prior]
    value = lambda c: f"(CASE WHEN {c}.s LIKE 'POSITIVE%' THEN abs({c}.v) ELSE {c}.v END)"
    names = {f"x{k}": value(c) for k, c in enumerate(now)} | {f"y{k}": value(c) for k, c in enumerate(then)}
    money = lambda cs: "len(list_distinct(list_filter([" + ", ".join([f"CASE WHEN {c}.u IN ('shares', 'ratio') THEN NULL ELSE {c}.u END" for c in cs] + (["currency"] if name in _DAILY else [])) + "], lambda z: z IS NOT NULL))) > 1"
    context = lambda cs: "len(list_distinct([" + ", ".join(f"coalesce({c}.d, '')" for c in cs) + "])) > 1"

    def usable(field: str, c: str) -> list[tuple[str, str]]:
        out = [("INPUT_SEMANTIC_GRADE_UNAPPROVED", f"coalesce({c}.g, '') NOT IN ('SOURCE_LINKED_DIRECT', 'SOURCE_LINKED_DERIVED', 'HYPOTHESIS_PROXY')")]
        out += [] if proxies else [("INPUT_SEMANTIC_GRADE_INCOMPATIBLE", f"{c}.g = 'HYPOTHESIS_PROXY'")]
        return out + ([("INPUT_SIGN_CONVENTION_UNAPPROVED", f"coalesce({c}.s, '') <> 'POSITIVE_OUTFLOW'")] if field == "capital_expenditure" else [])

    steps = [("PRICE_CURRENCY_MISSING", "currency IS NULL")] if name == "market_cap_sec_proxy" else []
    for i, c in zip(inputs, now, strict=True):
        steps += [("MISSING_INPUT", f"{c} IS NULL OR {c}.v IS NULL"), *usable(i, c)]
    ends = [f"{c}.e" if i == "market_cap_sec_proxy" else f"{c}.p" for i, c in zip(inputs, now, strict=True)]
    steps += [("INPUT_PERIOD_MISMATCH", f"len(list_distinct([{', '.join(ends)}])) > 1"), ("INPUT_CONTEXT_MISMATCH", context(now)), ("INPUT_CURRENCY_MISMATCH", money(now))]
    for i, c in zip(prior, then, strict=True):
        steps += [("PRIOR_FISCAL_YEAR_MISSING", f"NOT coalesce(h_{i}, false)"), ("PRIOR_FISCAL_ANCHOR_MISMATCH", f"{c} IS NULL"), *usable(i, c)]
    if prior:
        steps += [("INPUT_CONTEXT_MISMATCH", context(now + then)), ("INPUT_CURRENCY_MISMATCH", money(now + then))]
    steps += [(r, t.format(**names)) for r, t in tests] + [("NON_FINITE_RESULT", f"coalesce(NOT isfinite({formula.format(**names)}), true)")]
    ladder = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for r, t in steps) + " END"
    unit = "'ratio'" if prior else "currency" if name == "market_cap_sec_proxy" else "'usd/share'" if name == "book_value_per_share" else f"{now[0]}.u"
    sources = "list_sort(list_filter([" + ", ".join(f"{c}.id" for c in now + then) + "], lambda z: z IS NOT NULL))"
    turned = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c}.s LIKE 'POSITIVE%' AND {c}.v < 0 THEN '{k}=ABS_' || {c}.s END" for k, c in [*zip(inputs, now, strict=True), *((f"prior:{i}", c) for i, c in zip(prior, then, strict=True))]) + "], lambda z: z IS NOT NULL), '|')"
    day, period = ("at", "at") if name in _DAILY else ("NULL", f"{now[0]}.p")
    return f"""SELECT security_id, at, '{name}' AS field, {ladder} AS reason, {formula.format(**names)} AS v, {unit} AS u, {now[0]}.s AS s, '{"HYPOTHESIS_PROXY" if proxies else "SOURCE_LINKED_DERIVED"}' AS g, {now[0]}.d AS d,
  {period} AS p, coalesce({now[0]}.e, {now[0]}.p) AS e, {now[0]}.fy AS fiscal_year, {sources} AS ids, CAST({day} AS DATE) AS day, {turned} AS tr FROM {source} WHERE {"is_price" if name in _DAILY else "is_fact"}"""


def _sql_wave(n: int, versions: str, names: tuple[str, ...]) -> str:
    """CTEs ending in ``made{n}``."""
    inputs = sorted({i for x in names for i in _SQL_DEFINITIONS[x][0]})
    prior = sorted({i for x in names for i in _SQL_DEFINITIONS[x][1]})
    fact = "{'v': v, 'u': u, 's': s, 'g': g, 'd': d, 'p': p, 'e': e, 'fy': fiscal_year, 'id': id}"
    listed = ", ".join(f"'{i}'" for i in inputs)
    was = f""", old{n} AS (SELECT c.security_id, c.at, c.field, true AS h, arg_max({fact.replace("v,", "w.v,").replace(": u", ": w.u").replace(": s,", ": w.s,").replace(": g", ": w.g").replace(": d,", ": w.d,").replace(": p,", ": w.p,").replace(": e,", ": w.e,").replace("fiscal_year", "w.fiscal_year").replace(": id", ": w.id")}, (w.a, w.p, w.id)) FILTER (month(w.p) = month(c.x.p) AND day(w.p) = day(c.x.p)) AS x
  FROM cur{n} c JOIN {versions} w ON w.security_id = c.security_id AND w.field = c.field AND w.a <= c.at AND w.fiscal_year = c.x.fy - 1 GROUP BY 1, 2, 3)""" if prior else ""
    then = f" LEFT JOIN (SELECT security_id, at, {', '.join(f'any_value(x) FILTER (field = {i!r}) AS t_{i}, bool_or(h) FILTER (field = {i!r}) AS h_{i}' for i in prior)} FROM old{n} GROUP BY 1, 2) USING (security_id, at)" if prior else ""
    return f"""cur{n} AS (SELECT ev.security_id, ev.at, field, arg_max({fact}, (p, a, id)) AS x FROM ev JOIN {versions} w ON w.security_id = ev.security_id AND w.a <= ev.at WHERE field IN ({listed}) GROUP BY 1, 2, 3){was},
wide{n} AS (SELECT ev.*, {", ".join(f"n_{i}" for i in inputs)}{"".join(f", t_{i}, h_{i}" for i in prior)} FROM ev LEFT JOIN (SELECT security_id, at, {", ".join(f"any_value(x) FILTER (field = '{i}') AS n_{i}" for i in inputs)} FROM cur{n} GROUP BY 1, 2) USING (security_id, at){then}),
made{n} AS (SELECT * FROM ({" UNION ALL ".join(_sql_field(x, f"wide{n}") for x in names)}) QUALIFY reason IS NOT NULL OR row_number() OVER (PARTITION BY security_id, field, ids, day, reason IS NULL ORDER BY at) = 1)"""


_FIRST, _SECOND = tuple(x for x in _SQL_DEFINITIONS if x not in ("ebitda", "enterprise_value_sec_proxy")), ("ebitda", "enterprise_value_sec_proxy")
#: The common part of queries over all derived fields.
ORACLE_PARTS = f"""WITH base AS (SELECT l_suppkey AS security_id, year(l_shipdate)::INT AS fy, count(*) AS n, {", ".join(f"CAST(floor({x} + 0.00001) AS DOUBLE) AS {k}" for k, x in _SUMS.items())} FROM lineitem GROUP BY 1, 2),
fv AS (SELECT *, p AS e FROM ({_SQL_ROWS})),
pe AS (SELECT l_suppkey AS security_id, last_day(CAST(l_shipdate AS DATE)) AS at, last(floor(l_extendedprice / l_quantity) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS raw_close FROM lineitem GROUP BY 1, 2),
ev AS (SELECT coalesce(f.security_id, q.security_id) AS security_id, coalesce(f.at, q.at) AS at, f.at IS NOT NULL AS is_fact, q.at IS NOT NULL AS is_price, raw_close, currency FROM (SELECT DISTINCT security_id, a AS at FROM fv) f
  FULL JOIN (SELECT *, {_dialect(_CURRENCY)} AS currency FROM pe) q ON f.security_id = q.security_id AND f.at = q.at),
{_sql_wave(1, "fv", _FIRST)},
dv AS (SELECT security_id, fiscal_year, field, v, u, s, g, d, p, at AS a, field || array_to_string(ids, '|') || coalesce(day::VARCHAR, '') AS id, e FROM made1 WHERE reason IS NULL),
fv2 AS (SELECT security_id, fiscal_year, field, v, u, s, g, d, p, a, id, e FROM fv UNION ALL SELECT * FROM dv),
{_sql_wave(2, "fv2", _SECOND)}"""
_ORACLE = f"""{ORACLE_PARTS}
SELECT security_id, at, field, reason, CASE WHEN reason IS NULL THEN round(v, 6) + 0.0 END AS value, CASE WHEN reason IS NULL THEN u END AS unit FROM (SELECT * FROM made1 UNION ALL SELECT * FROM made2)"""


# a word of the dialect
@query("fd_07_08_derived_fields", re.sub(r"\bat\b", '"at"', _ORACLE))
def fd_07(spark, sf_dir):
    """All thirteen fields of all suppliers at every filing and month's close, with a value or the reason for none."""
    out = derived_fields(spark, sf_dir)
    return out.select("security_id", "at", "field", "reason", rounded(F.col("value")).alias("value"), F.when(F.col("reason").isNull(), F.col("unit")).alias("unit"))
