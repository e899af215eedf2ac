"""Discrete quarters and trailing twelve months from cumulative facts, again at every restatement.

Facts: security_id, field, unit, fiscal_year, fiscal_period (Q1, Q2, Q3, FY), period_start, period_end, available_at, accession,
source_id, value. Cumulative facts of one fiscal year share ``period_start``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import scalar as sc

SERIES = ("security_id", "field", "unit")


def label(period: Column, days: Column) -> Column:
    """What a fact covers: Q1, H1, 9M or FY by fiscal period and inclusive length."""
    return (
        F.when((period == "Q1") & days.between(70, 120), "Q1").when((period == "Q2") & days.between(150, 220), "H1")
        .when((period == "Q3") & days.between(240, 310), "9M").when((period == "FY") & days.between(330, 380), "FY")
    )


def quarters(facts: DataFrame) -> DataFrame:
    """Discrete quarters Q1, H1 - Q1, 9M - H1, FY - 9M, each as soon as both sides are known, and anew when one is restated.

    The latest known fact of each label is a running last value over availability; every event proposes the differences that
    it completes. Differences that repeat a pair of sources are dropped, as are pairs whose end does not grow.
    """
    days = F.datediff("period_end", "period_start") + 1
    rows = facts.withColumn("label", label(F.col("fiscal_period"), days)).where("label is not null")
    order = Window.partitionBy(*SERIES, "period_start").orderBy("available_at", "accession", "source_id").rowsBetween(Window.unboundedPreceding, 0)
    fact = F.struct("value", "period_end", "source_id")
    known = {k: F.last(F.when(F.col("label") == k, fact), ignorenulls=True).over(order) for k in ("Q1", "H1", "9M", "FY")}
    rows = rows.select(*SERIES, "period_start", "fiscal_year", "available_at", "accession", *(v.alias(k) for k, v in known.items()))
    steps = (("Q1", None, "Q1"), ("Q2", "Q1", "H1"), ("Q3", "H1", "9M"), ("Q4", "9M", "FY"))

    def step(quarter: str, before: str | None, upto: str) -> Column:
        b, u = (F.col(f"`{before}`") if before else None), F.col(f"`{upto}`")
        value = u["value"] - b["value"] if before else u["value"]
        good = u.isNotNull() if not before else u.isNotNull() & b.isNotNull() & (u["period_end"] > b["period_end"])
        start = F.date_add(b["period_end"], 1) if before else F.col("period_start")
        sources = F.array(b["source_id"], u["source_id"]) if before else F.array(u["source_id"])
        return F.when(good, F.struct(F.lit(quarter).alias("quarter"), start.alias("quarter_start"), u["period_end"].alias("period_end"), value.alias("value"), sources.alias("sources")))

    out = rows.select(*SERIES, "fiscal_year", "available_at", "accession", F.explode(F.array_compact(F.array(*(step(*s) for s in steps)))).alias("q")).select(*SERIES, "fiscal_year", "available_at", "accession", "q.*")
    first = Window.partitionBy(*SERIES, "quarter", "sources").orderBy("available_at", "accession")
    return out.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def trailing_year(q: DataFrame) -> DataFrame:
    """The sum of the latest four quarters known at each event, if their ends lie 70 to 120 days apart.

    A series has a few dozen quarters, so what is known is a running array, reduced with array functions.
    """
    order = Window.partitionBy(*SERIES).orderBy("available_at", "accession", "period_end").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct("period_end", "available_at", "accession", "value", "sources")).over(order)

    def last_four(all_: Column) -> Column:
        # of each period end the last one, which sorts after its older versions
        latest = F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["period_end"] > x["period_end"], F.lit(True)))
        return F.slice(latest, F.greatest(F.size(latest) - 3, F.lit(1)), 4)

    def summed(four: Column) -> Column:
        good = F.size(four) == 4
        for i in (1, 2, 3):
            good = good & F.datediff(F.get(four, F.lit(i))["period_end"], F.get(four, F.lit(i - 1))["period_end"]).between(70, 120)
        row = F.struct(F.get(four, F.lit(3))["period_end"].alias("period_end"), F.aggregate(four, F.lit(0.0), lambda a, x: a + x["value"]).alias("value"), F.flatten(F.transform(four, lambda x: x["sources"])).alias("sources"))
        return F.when(good, F.array(row))

    # each array is bound once, and the generator keeps a later filter from repeating them
    found = sc.bound(sc.bound(F.sort_array(F.col("seen")), last_four), summed)
    out = q.withColumn("seen", seen).select(*SERIES, "available_at", "accession", F.explode(found).alias("y")).select(*SERIES, "y.period_end", "available_at", "accession", "y.value", "y.sources")
    first = Window.partitionBy(*SERIES, "sources").orderBy("available_at", "accession")
    return out.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def annual_proxy(facts: DataFrame, ttm: DataFrame) -> DataFrame:
    """Annual facts that stand in for a trailing year, where that series and period has none."""
    annual = facts.where("fiscal_period = 'FY'")
    return annual.join(ttm.select(*SERIES, "period_end").distinct(), [*SERIES, "period_end"], "left_anti")


def by_basis(facts: DataFrame) -> DataFrame:
    """All bases as one table: RAW, INSTANT, ANNUAL, QUARTERLY_DISCRETE and TTM, with the grade of each value.

    ``fact_type`` (INSTANT or DURATION; all durations without the column) says which rules apply. ANNUAL takes facts that cover
    a whole fiscal year. Where a year has no trailing sum, its annual fact stands in as TTM with the grade HYPOTHESIS_PROXY.
    """
    kind = F.col("fact_type") if "fact_type" in facts.columns else F.lit("DURATION")
    facts = facts.withColumn("fact_type", kind)
    spans = facts.where("fact_type = 'DURATION'")
    annual = spans.where(label(F.col("fiscal_period"), F.datediff("period_end", "period_start") + 1) == "FY")
    q = quarters(spans)
    ttm = trailing_year(q)
    keep = (*SERIES, "period_end", "available_at", "accession", "value")
    direct, made, proxy = "SOURCE_LINKED_DIRECT", "SOURCE_LINKED_DERIVED", "HYPOTHESIS_PROXY"
    parts = ((facts, "RAW", direct), (facts.where("fact_type = 'INSTANT'"), "INSTANT", direct), (annual, "ANNUAL", direct), (q, "QUARTERLY_DISCRETE", made), (ttm, "TTM", made), (annual_proxy(annual, ttm), "TTM", proxy))
    return reduce(DataFrame.unionByName, (df.select(*keep, F.lit(basis).alias("basis"), F.lit(grade).alias("grade")) for df, basis, grade in parts))
