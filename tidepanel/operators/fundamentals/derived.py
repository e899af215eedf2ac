"""Derived accounting fields with reason codes.

A derived field has a value or the first reason against it, never both. Inputs are the latest versions known at an event; ratios
that need the year before take exactly that fiscal year, at the same date of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc


#: Fixed values of the contract: what a grade may be, which conventions make a negative value positive, units that are no currency.
APPROVED_GRADES = ("SOURCE_LINKED_DIRECT", "SOURCE_LINKED_DERIVED", "HYPOTHESIS_PROXY")
POSITIVE_CONVENTIONS = ("POSITIVE_OUTFLOW", "POSITIVE_EXPENSE", "POSITIVE_ADD_BACK", "POSITIVE_ADDBACK", "POSITIVE_OBLIGATION")
REQUIRED_SIGNS = {"capital_expenditure": "POSITIVE_OUTFLOW"}
NON_CURRENCY_UNITS = ("", "SHARE", "SHARES", "RATIO", "PURE", "NUMBER")


@dataclass(frozen=True)
class Definition:
    """A derived field: inputs in order, those that also need the year before, its formula over values now and then, and
    tests of the result's own (reason to condition that rejects)."""

    inputs: tuple[str, ...]
    formula: Callable[[Callable, Callable], Column]
    prior: tuple[str, ...] = ()
    unit: str | None = None
    grade: str = "SOURCE_LINKED_DERIVED"
    tests: Callable[[Callable, Callable], dict[str, Column]] = lambda now, then: {}
    daily: bool = False


def _mean(field: str):
    return lambda now, then: (now(field) + then(field)) / 2


def _average(flow: Callable[[Callable], Column], stock: str, *inputs: str) -> Definition:
    """A flow over the mean of a balance and that of the year before."""
    mean = _mean(stock)
    return Definition((*inputs, stock), lambda now, then: sc.divide(flow(now), mean(now, then)), (stock,), "ratio", tests=lambda now, then: {"NON_POSITIVE_DENOMINATOR": mean(now, then) <= 0})


def _growth(field: str) -> Definition:
    return Definition((field,), lambda now, then: sc.divide(now(field), then(field)) - 1, (field,), "ratio", tests=lambda now, then: {"NON_POSITIVE_DENOMINATOR": then(field) <= 0})


_DEBT = ("short_term_debt", "long_term_debt_current", "long_term_debt_noncurrent")
DEFINITIONS = {
    "total_debt": Definition(_DEBT, lambda now, then: now(_DEBT[0]) + now(_DEBT[1]) + now(_DEBT[2]), tests=lambda now, then: {"NEGATIVE_DEBT_INPUT": F.least(*map(now, _DEBT)) < 0}),
    "working_capital": Definition(("current_assets", "current_liabilities"), lambda now, then: now("current_assets") - now("current_liabilities")),
    "free_cash_flow": Definition(("operating_cash_flow", "capital_expenditure"), lambda now, then: now("operating_cash_flow") - now("capital_expenditure")),
    "ebit": Definition(("net_income", "income_tax_expense", "interest_expense"), lambda now, then: now("net_income") + now("income_tax_expense") + now("interest_expense")),
    "ebitda": Definition(("ebit", "depreciation_and_amortization"), lambda now, then: now("ebit") + now("depreciation_and_amortization")),
    "roa": _average(lambda now: now("net_income"), "total_assets", "net_income"),
    "roe": _average(lambda now: now("net_income"), "stockholders_equity", "net_income"),
    "inventory_turnover": _average(lambda now: now("revenue") - now("gross_profit"), "inventory", "revenue", "gross_profit"),
    "asset_growth": _growth("total_assets"),
    "revenue_growth": _growth("revenue"),
    "book_value_per_share": Definition(("stockholders_equity", "shares_outstanding_sec"), lambda now, then: sc.divide(now("stockholders_equity"), now("shares_outstanding_sec")), unit="per share", grade="HYPOTHESIS_PROXY",
        tests=lambda now, then: {"NON_POSITIVE_DENOMINATOR": now("shares_outstanding_sec") <= 0}),
    "market_cap_sec_proxy": Definition(("shares_outstanding_sec",), lambda now, then: now("shares_outstanding_sec") * F.col("raw_close"), grade="HYPOTHESIS_PROXY", daily=True,
        tests=lambda now, then: {"NON_POSITIVE_PRICE": F.coalesce(F.col("raw_close") <= 0, F.lit(True)), "NON_POSITIVE_INPUT": now("shares_outstanding_sec") <= 0}),
    "enterprise_value_sec_proxy": Definition(("market_cap_sec_proxy", "total_debt", "cash_and_cash_equivalents"), lambda now, then: now("market_cap_sec_proxy") + now("total_debt") - now("cash_and_cash_equivalents"), grade="HYPOTHESIS_PROXY", daily=True),
}
_PAYLOAD = ("value", "unit", "semantic_grade", "sign_convention", "dimensions", "fiscal_year", "fiscal_period", "accounting_period_end")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sequence(versions: DataFrame, prices: DataFrame | None, parts: int | None) -> DataFrame:
    """A row for each event (security_id, at): is_fact, is_price, raw_close, currency, and of each input what is new there
    (``new_``) and, of those asked for a year before, all versions that are (``old_``). One shuffle, by security."""
    order, old = ("period_end", "available_at", "source_id"), ("available_at", "period_end", "source_id")
    fact = F.struct(*order, "field", *_PAYLOAD)
    rows = versions.select("security_id", F.col("available_at").alias("at"), fact.alias("f"))
    if prices is not None:
        quoted = prices.where(F.col("raw_close").isNotNull())
        rows = rows.unionByName(quoted.select("security_id", "at", F.struct(F.col("raw_close").cast("double").alias("raw_close"), "currency").alias("price")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("price", F.lit(None).cast("struct<raw_close: double, currency: string>"))
    is_it = lambda name: F.col("f.field") == name
    new = (F.max(F.when(is_it(i), F.col("f"))).alias(f"new_{i}") for i in _INPUTS)
    told = (F.collect_list(F.when(is_it(p), F.struct(*(F.col(f"f.{c}").alias(c) for c in (*old, "field", *_PAYLOAD))))).alias(f"old_{p}") for p in _PRIOR)
    dealt = rows.repartition("security_id") if parts is None else rows.repartition(parts, "security_id")
    events = dealt.groupBy("security_id", "at").agg(F.max("price").alias("price"), F.bool_or(F.col("f").isNotNull()).alias("is_fact"), *new, *told)
    return events.withColumns({"is_price": F.col("price").isNotNull(), "raw_close": F.col("price.raw_close"), "currency": F.col("price.currency")}).drop("price")


def _inputs_at(events: DataFrame) -> DataFrame:
    """Each event with the latest known version of each input (NULL without one), its version for the same date a fiscal year
    earlier (``then_``) and whether that year has any (``year_``): running maxima and lists over the security's events."""
    upto = Window.partitionBy("security_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # only filings ask for the year before, so prices aren't in the sequence that lists versions
    filed = Window.partitionBy("security_id", "is_fact").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    now = {i: F.max(f"new_{i}").over(upto).dropFields("available_at") for i in _INPUTS}
    known = {f"known_{p}": F.flatten(F.collect_list(F.when(F.size(f"old_{p}") > 0, F.col(f"old_{p}"))).over(filed)) for p in _PRIOR}
    rows = events.withColumns(now | known)

    def year_before(p: str) -> Column:
        return F.filter(f"known_{p}", lambda x: x["fiscal_year"] == F.col(f"{p}.fiscal_year") - 1)

    def anchored(p: str):
        def same(x: Column) -> Column:
            now = F.col(p)
            period = now["fiscal_period"].isNull() | x["fiscal_period"].isNull() | (F.upper(now["fiscal_period"]) == F.upper(x["fiscal_period"]))
            day = (F.month(x["period_end"]) == F.month(now["period_end"])) & (F.day(x["period_end"]) == F.day(now["period_end"]))
            return F.coalesce(period & day, F.lit(False))

        return same

    def told_of(p: str) -> Column:
        return _bound(year_before(p), lambda v: F.struct((F.size(v) > 0).alias("year"), F.array_max(F.filter(v, anchored(p))).dropFields("available_at").alias("then")))

    told = {p: told_of(p) for p in _PRIOR}
    rows = rows.withColumns({f"told_{p}": F.when(F.col("is_fact"), t) for p, t in told.items()})
    rows = rows.withColumns({f"then_{p}": F.col(f"told_{p}.then") for p in _PRIOR} | {f"year_{p}": F.coalesce(f"told_{p}.year", F.lit(False)) for p in _PRIOR})
    return rows.drop(*(f"{k}_{p}" for k in ("known", "old", "told") for p in _PRIOR), *(f"new_{i}" for i in _INPUTS))


def _reason(r: Column, currency: Column) -> Column:
    """The first reason against a derived field, or NULL, from its struct r: field, grade, daily, now, then and years.

    Each input in order is there, of an approved grade and sign; then ends of periods, contexts and currencies agree, the year
    before is there and agrees too.
    """
    def usable(x: Column) -> Column:
        grade, sign = F.upper(F.coalesce(x["semantic_grade"], F.lit(""))), F.upper(F.coalesce(x["sign_convention"], F.lit("")))
        out = F.when(~grade.isin(*APPROVED_GRADES), "INPUT_SEMANTIC_GRADE_UNAPPROVED").when((r["grade"] == "SOURCE_LINKED_DERIVED") & (grade == "HYPOTHESIS_PROXY"), "INPUT_SEMANTIC_GRADE_INCOMPATIBLE")
        for name, needed in REQUIRED_SIGNS.items():
            out = out.when((x["field"] == name) & (sign != needed), "INPUT_SIGN_CONVENTION_UNAPPROVED")
        return out

    def first(reasons: Column) -> Column:
        return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))

    def differ(values: Column) -> Column:
        return F.size(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))) > 1

    def agree(facts: Column) -> Column:
        money = F.transform(facts, lambda x: F.when(~F.upper(F.coalesce(x["unit"], F.lit(""))).isin(*NON_CURRENCY_UNITS), x["unit"]))
        money = F.array_append(money, F.when(r["daily"], currency))
        return F.when(differ(F.transform(facts, lambda x: F.coalesce(x["dimensions"], F.lit("")))), "INPUT_CONTEXT_MISMATCH").when(differ(money), "INPUT_CURRENCY_MISMATCH")

    now, then = r["now"], r["then"]
    ends = F.transform(now, lambda x: F.when(x["field"] == "market_cap_sec_proxy", x["accounting_period_end"]).otherwise(x["period_end"]))
    return F.coalesce(
        F.when((r["field"] == "market_cap_sec_proxy") & currency.isNull(), "PRICE_CURRENCY_MISSING"),
        first(F.transform(now, lambda x: F.when(x["value"].isNull() | F.isnan(x["value"]), "MISSING_INPUT").otherwise(usable(x)))),
        F.when(differ(ends), "INPUT_PERIOD_MISMATCH"), agree(now),
        first(F.zip_with(r["years"], then, lambda year, x: F.when(~F.coalesce(year, F.lit(False)), "PRIOR_FISCAL_YEAR_MISSING").when(x["field"].isNull(), "PRIOR_FISCAL_ANCHOR_MISMATCH").otherwise(usable(x)))),
        F.when(F.size(then) > 0, agree(F.concat(now, then))))


def _positive(facts: Column) -> Column:
    """Values of inputs, made positive where their convention asks for it."""
    return F.transform(facts, lambda x: F.when(F.upper(F.coalesce(x["sign_convention"], F.lit(""))).isin(*POSITIVE_CONVENTIONS), F.abs(x["value"])).otherwise(x["value"]))


def sign_log(now: Column, then: Column) -> Column:
    """A map from inputs (``prior:`` before those of the year before) to what was done to their value, where anything was."""
    def entries(facts: Column, prefix: str) -> Column:
        convention = lambda x: F.upper(F.coalesce(x["sign_convention"], F.lit("")))
        turned = F.filter(facts, lambda x: convention(x).isin(*POSITIVE_CONVENTIONS) & (x["value"] < 0))
        return F.transform(turned, lambda x: F.struct(F.concat(F.lit(prefix), x["field"]).alias("key"), F.concat(F.lit("ABS_"), convention(x)).alias("value")))

    return F.map_from_entries(F.concat(entries(now, ""), entries(then, "prior:")))


def _judged(names: tuple[str, ...]) -> Column:
    """An array of structs (field, value, reason, unit, ...) of the named fields that an event of ``_inputs_at`` asks for."""
    def asked(name: str) -> Column:
        d = DEFINITIONS[name]
        then, years = ([F.col(f"{k}_{f}") for f in d.prior] for k in ("then", "year"))
        none = F.filter(F.array(F.col(d.inputs[0])), lambda x: F.lit(False))
        row = F.struct(
            F.lit(name).alias("field"), F.lit(d.grade).alias("grade"), F.lit(d.daily).alias("daily"), F.array(*(F.col(i) for i in d.inputs)).alias("now"),
            (F.array(*then) if then else none).alias("then"), F.array(*years).cast("array<boolean>").alias("years"))
        return F.when(F.col("is_price") if d.daily else F.col("is_fact"), row)

    ratios, shares = ([n for n in names if DEFINITIONS[n].unit == u] for u in ("ratio", "per share"))

    def valued(r: Column):
        def of(v: Column) -> Column:
            value, own = F.lit(None).cast("double"), F.lit(None).cast("string")
            for name in names:
                d = DEFINITIONS[name]
                now = lambda f, d=d: F.get(v["x"], F.lit(d.inputs.index(f)))
                then = lambda f, d=d: F.get(v["y"], F.lit(d.prior.index(f)))
                is_it = r["field"] == name
                value = F.when(is_it, d.formula(now, then)).otherwise(value)
                for reason, holds in d.tests(now, then).items():
                    own = F.when(is_it & holds, reason).otherwise(own)
            return F.struct(value.alias("value"), F.coalesce(v["reason"], own).alias("reason"))

        return of

    def told(r: Column):
        def of(v: Column) -> Column:
            reason = F.coalesce(v["reason"], F.when(~sc.is_finite(v["value"]), "NON_FINITE_RESULT"))
            first = F.get(r["now"], F.lit(0))
            money = F.get(F.filter(F.transform(r["now"], lambda x: F.when(~F.upper(F.coalesce(x["unit"], F.lit(""))).isin(*NON_CURRENCY_UNITS), x["unit"])), lambda u: u.isNotNull()), F.lit(0))
            unit = F.when(r["field"].isin(*ratios), "ratio").when(r["field"] == "market_cap_sec_proxy", F.col("currency")).when(r["field"].isin(*shares), F.concat(money, F.lit("/share"))).otherwise(F.coalesce(money, F.lit("")))
            sources = F.sort_array(F.array_compact(F.transform(F.concat(r["now"], r["then"]), lambda x: x["source_id"])))
            return F.struct(
                r["field"].alias("field"), reason.alias("reason"), F.when(reason.isNull(), v["value"]).alias("value"), unit.alias("unit"), r["grade"].alias("semantic_grade"),
                first["sign_convention"].alias("sign_convention"), first["dimensions"].alias("dimensions"), F.when(r["daily"], F.year("at")).otherwise(first["fiscal_year"]).cast("int").alias("fiscal_year"),
                F.when(r["daily"], "DAILY").otherwise(first["fiscal_period"]).alias("fiscal_period"), F.when(r["daily"], F.col("at")).otherwise(first["period_end"]).alias("period_end"),
                F.coalesce(first["accounting_period_end"], first["period_end"]).alias("accounting_period_end"), sources.alias("sources"), sign_log(r["now"], r["then"]).alias("transformations"))

        return of

    def one(r: Column) -> Column:
        values = F.struct(_positive(r["now"]).alias("x"), _positive(r["then"]).alias("y"), _reason(r, F.col("currency")).alias("reason"))
        return _bound(_bound(values, valued(r)), told(r))

    return F.transform(F.array_compact(F.array(*map(asked, names))), one)


#: Derived fields that others take as inputs, all inputs that are no derived fields, and those asked for a year before.
_EARLY = ("total_debt", "ebit", "market_cap_sec_proxy")
_INPUTS = tuple(sorted({i for d in DEFINITIONS.values() for i in d.inputs} - set(_EARLY)))
_PRIOR = tuple(sorted({f for d in DEFINITIONS.values() for f in d.prior}))


def derive(versions: DataFrame, prices: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """All derived fields as rows (security_id, at, field, value, unit, reason, period_end, transformations, ...): a value or the
    first reason against it, at every event, and a map of the inputs whose sign was turned.

    ``versions``: security_id, field, value, unit, semantic_grade, sign_convention, dimensions, fiscal_year, fiscal_period,
    period_end, available_at (a date), source_id, each field on the one basis that its definitions ask for. ``prices``:
    security_id, at, raw_close, currency, one for each security and time; the two proxies are made where there is one. Nothing
    is substituted: a missing input is a reason. Fields made of other derived fields see those as versions known from the event
    that made them.

    A security's filings and prices are one sequence in one task; all that follows its one shuffle keeps that partitioning, and
    its rows are many times as wide as those shuffled: ``parts`` is the number of its tasks, which should grow with the input.
    """
    versions = versions.withColumn("accounting_period_end", F.col("period_end")) if "accounting_period_end" not in versions.columns else versions
    rows = _inputs_at(_sequence(versions, prices, parts)).withColumn("made", _judged(_EARLY))
    upto = Window.partitionBy("security_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def fact(name: str) -> Column:
        """What later events see of an early field that is made here."""
        one = lambda r: F.struct(r["period_end"].alias("period_end"), F.col("at").alias("available_at"), F.concat_ws("|", F.lit(name), r["sources"]).alias("source_id"), F.lit(name).alias("field"), *(r[c].alias(c) for c in _PAYLOAD))
        return F.get(F.transform(F.filter("made", lambda r: (r["field"] == name) & r["reason"].isNull()), one), F.lit(0))

    rows = rows.withColumns({f"new_{n}": fact(n) for n in _EARLY})
    rows = rows.withColumns({n: F.max(f"new_{n}").over(upto).dropFields("available_at") for n in _EARLY})
    rest = _judged(tuple(n for n in DEFINITIONS if n not in _EARLY))
    out = rows.select("security_id", "at", F.explode(F.concat("made", rest)).alias("r")).select("security_id", "at", "r.*")
    # the same inputs give a value once, at the first event that has them; a price is new at each
    day = F.when(F.col("fiscal_period") == "DAILY", F.col("at"))
    place = F.row_number().over(Window.partitionBy("security_id", "field", "sources", day, F.col("reason").isNull()).orderBy("at"))
    return out.withColumn("__k", place).where("reason is not null or __k = 1").drop("__k")


def yearly_growth(facts: DataFrame) -> DataFrame:
    """Growth against the same fiscal period a year before, or why there is none."""
    prior = facts.select("security_id", "field", "fiscal_period", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("value").alias("before"), F.col("period_end").alias("anchor"))
    rows = facts.join(prior, ["security_id", "field", "fiscal_period", "fiscal_year"], "left")
    same_day = F.date_format("anchor", "MM-dd") == F.date_format("period_end", "MM-dd")
    reason = sc.first_reason({"PRIOR_FISCAL_YEAR_MISSING": F.col("before").isNull(), "PRIOR_FISCAL_ANCHOR_MISMATCH": ~same_day, "NON_POSITIVE_DENOMINATOR": F.col("before") <= 0})
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("growth", F.when(F.col("reason").isNull(), F.try_divide("value", "before") - 1))


def normalised_sign(value: Column, convention: Column) -> Column:
    """The absolute value where the convention is a positive one."""
    return F.when(convention.startswith("POSITIVE"), F.abs(value)).otherwise(value)


def once_per_inputs(derived: DataFrame, inputs: list[str]) -> DataFrame:
    """The first row of each derived value with the same inputs."""
    return derived.withColumn("identity", sc.identity(*(F.col(i) for i in inputs))).groupBy("field", "identity").agg(F.min_by(F.struct(*derived.columns), "session").alias("r")).select("r.*")
