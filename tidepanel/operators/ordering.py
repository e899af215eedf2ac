"""Places and ranks in one order of all rows, without bringing all rows into one task.

Rows are dealt to cells by quantiles of the value; each cell is sorted by itself, and the cells' counts (a few thousand rows at
most) give each its offset. A value that is itself a quantile, as any frequent one is, has a cell of its own, which is cut
further by quantiles of the key. The quantiles only balance the cells: any bounds give the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CELL_ROWS, LEAST_PARTS, MOST_PARTS = 2_000_000, 32, 2_048


def _less(bounds: list[float], x: Column) -> Column:
    """How many of the bounds lie below x."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x))


def _cell(bounds: list[float], x: Column) -> Column:
    """An even number between two bounds, an odd one at a bound; missing values come last and have an odd one."""
    at = F.array_contains(F.array(*map(F.lit, bounds)), x) if bounds else F.lit(False)
    return F.when(x.isNull(), 2 * len(bounds) + 1).otherwise(2 * _less(bounds, x) + at.cast("int"))


def _bounds(rows: DataFrame, columns: list[str], parts: int) -> list[list[float]]:
    """Up to ``parts`` - 1 quantiles of each column, the only values that reach the driver."""
    found = rows.approxQuantile(columns, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return [sorted(set(q)) for q in found]


def places(rows: DataFrame, value: str, key: str, name: str = "place", parts: int | None = None) -> DataFrame:
    """Rows with their place, from 1, by ``value`` (highest first, missing and NaN last), then by ``key``.

    Both are numbers and compared as doubles; rows equal in both have places in any order. Rows are read three times: for
    the bounds, the counts and the result, and once more for their number, which decides ``parts`` where that is not given:
    a cell has ``CELL_ROWS`` rows or so, up to ``MOST_PARTS`` cells of values.
    """
    parts = max(LEAST_PARTS, min(MOST_PARTS, -(-rows.count() // CELL_ROWS))) if parts is None else parts
    x = F.col(value).cast("double")
    ready = rows.withColumns({"__x": F.when(~F.isnan(x), 0.0 - x), "__k": F.col(key).cast("double")})
    values, keys = _bounds(ready, ["__x", "__k"], parts)
    ready = ready.withColumn("__cell", _cell(values, F.col("__x")))
    ready = ready.withColumn("__part", F.when(F.col("__cell") % 2 == 1, _less(keys, F.col("__k"))).otherwise(0))
    counts = ready.groupBy("__cell", "__part").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * parts**2 rows
    offsets = counts.select("__cell", "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__cell", "__part").orderBy(F.asc_nulls_last("__x"), "__k"))
    out = ready.withColumn("__within", within).join(F.broadcast(offsets), ["__cell", "__part"])
    return out.withColumn(name, F.col("__before") + F.col("__within")).drop("__x", "__k", "__cell", "__part", "__within", "__before")


def pooled_ranks(rows: DataFrame, value: str, name: str, *by: str, parts: int = 32, bounds: list[float] | None = None) -> DataFrame:
    """Rows with the rank of ``value`` among all rows of ``by`` (or of the table), ties at their middle; missing ones have none.

    Equal values are counted first, so ranks are found on distinct values, however often one occurs. ``by`` names few groups.
    ``bounds`` are quantiles of the value, where they are known.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    n = n.withColumn("__x", F.col(value).cast("double"))
    bounds = _bounds(n, ["__x"], parts)[0] if bounds is None else bounds
    n = n.withColumn("__cell", _cell(bounds, F.col("__x")))
    upto = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.groupBy(*by, "__cell").agg(F.sum("__n").alias("__all")).select(*by, "__cell", F.coalesce(F.sum("__all").over(upto), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__cell").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = n.withColumn("__within", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(offsets), [*by, "__cell"])
    ranked = ranked.select(*by, value, (F.col("__before") + F.col("__within") + (F.col("__n") + 1) / 2).alias(name))
    return rows.join(ranked, [*by, value], "left")


def pooled_rank_corr(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Spearman's correlation of x and y over all rows of each ``by`` that have both: (by, pooled)."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    of_x, of_y = _bounds(both.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), ["x", "y"], 32)
    both = pooled_ranks(pooled_ranks(both, x, "__rx", *by, bounds=of_x), y, "__ry", *by, bounds=of_y)
    varies = F.stddev_pop("__rx") * F.stddev_pop("__ry")
    return both.groupBy(*by).agg(F.when(varies > 1e-12, F.covar_pop("__rx", "__ry") / varies).alias("pooled"))
