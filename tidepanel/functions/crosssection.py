"""Operators across the securities of one session."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SESSION = ("session",)


def across(*by: str | Column) -> WindowSpec:
    return Window.partitionBy(*(by or SESSION))


def average_rank(x: Column, *by: str | Column) -> Column:
    """Rank of x from 1, ties at their middle; missing values have none. One sort gives rank and ties."""
    order = across(*(by or SESSION), x.isNull()).orderBy(x)
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def rank(x: Column, *by: str | Column) -> Column:
    """Share of the session's values up to x, ties at their middle."""
    return average_rank(x, *by) / F.count(x).over(across(*by))


def group_rank(x: Column, group: Column, *by: str | Column) -> Column:
    by = by or SESSION
    return F.when(group.isNotNull(), rank(x, *by, group))


def group_neutralize(x: Column, group: Column, *by: str | Column) -> Column:
    """x less the mean of its group; without a group NULL."""
    by = by or SESSION
    return F.when(group.isNotNull(), x - F.avg(x).over(across(*by, group)))


def bucket(share: Column, n: int) -> Column:
    """1 to n by the ceiling of a rank share."""
    return F.least(F.greatest(F.ceil(share * n), F.lit(1)), F.lit(n))


def positional_deciles(score: Column, key: Column, n: int, *by: str | Column) -> Column:
    """n nearly equal runs of (score, key); the first runs take what is left over."""
    return F.when(score.isNotNull(), F.ntile(n).over(across(*(by or SESSION), score.isNull()).orderBy(score, key)))


def integer_deciles(score: Column, key: Column, n: int, *by: str | Column) -> Column:
    by = by or SESSION
    place = F.row_number().over(across(*by, score.isNull()).orderBy(score, key)) - 1
    return F.when(score.isNotNull(), F.least(F.lit(n), F.floor(place * n / F.count(score).over(across(*by))) + 1))


def descending_place(score: Column, key: Column, *by: str | Column) -> Column:
    """1 for the highest score; ties by key, missing scores last."""
    return F.row_number().over(across(*(by or SESSION)).orderBy(score.desc_nulls_last(), key))


def in_top(score: Column, key: Column, share: float, *by: str | Column) -> Column:
    """Whether a row is among the highest ceil(share * count), one at least."""
    by = by or SESSION
    most = F.greatest(F.lit(1), F.ceil(F.round(F.count(score).over(across(*by)) * share, 9)))
    return score.isNotNull() & (descending_place(score, key, *by) <= most)


def oriented(share: Column, direction: Column) -> Column:
    return F.when(direction == 1, share).otherwise(1 - share)
