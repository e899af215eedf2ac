"""Trailing operators of one security over sessions of a dense grid.

A full window is required: a missing value in it gives NULL. All frames share one partitioning and one order, so that any
number of them needs a single shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


KEY, TIME = "security_id", "session"
#: Under this product of deviations a correlation is missing.
FLAT = 1e-12


def history(key: str = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def trailing(n: int, key: str = KEY, time: str = TIME) -> WindowSpec:
    if n < 1:
        raise ValueError("a window has one session at least")
    return history(key, time).rowsBetween(1 - n, 0)


def running(key: str = KEY, time: str = TIME) -> WindowSpec:
    return history(key, time).rowsBetween(Window.unboundedPreceding, 0)


def full(x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(trailing(n)) == n, value)


def _held(x: Column, n: int) -> Column:
    return F.collect_list(x).over(trailing(n))


def ts_delay(x: Column, n: int) -> Column:
    return F.lag(x, n).over(history())


def ts_delta(x: Column, n: int) -> Column:
    return x - ts_delay(x, n)


def ts_change(x: Column, n: int = 1) -> Column:
    return F.try_divide(x, ts_delay(x, n)) - 1


def ts_mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(trailing(n)))


def ts_std_dev(x: Column, n: int) -> Column:
    """Population deviation."""
    return full(x, n, F.stddev_pop(x).over(trailing(n)))


def ts_sum(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x).over(trailing(n)))


def _pair(x: Column, y: Column) -> tuple[Column, Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y), F.when(both, F.lit(1))


def ts_covariance(x: Column, y: Column, n: int) -> Column:
    """Population covariance."""
    a, b, both = _pair(x, y)
    return full(both, n, F.covar_pop(a, b).over(trailing(n)))


def ts_corr(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation; a flat side gives NULL."""
    a, b, both = _pair(x, y)
    w = trailing(n)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return full(both, n, F.when(spread > FLAT, F.covar_pop(a, b).over(w) / spread))


def ts_beta(x: Column, y: Column, n: int) -> Column:
    """Slope of x on y."""
    return F.try_divide(ts_covariance(x, y, n), ts_covariance(y, y, n))


def ts_arg_min(x: Column, n: int) -> Column:
    """Sessions back to the oldest least value."""
    held = _held(x, n)
    return full(x, n, n - F.array_position(held, F.array_min(held)))


def ts_arg_max(x: Column, n: int) -> Column:
    held = _held(x, n)
    return full(x, n, n - F.array_position(held, F.array_max(held)))


def ts_min(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(trailing(n)))


def ts_max(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(trailing(n)))


def ts_scale(x: Column, n: int) -> Column:
    w = trailing(n)
    return full(x, n, F.try_divide(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)))


def ts_rank(x: Column, n: int) -> Column:
    """Share of the window up to the present value, ties in the middle."""
    held = _held(x, n)
    below = F.size(F.filter(held, lambda v: v < x))
    equal = F.size(F.filter(held, lambda v: v == x))
    return full(x, n, (below + (equal + 1) / 2) / n)


def ts_zscore(x: Column, n: int) -> Column:
    return F.try_divide(x - ts_mean(x, n), ts_std_dev(x, n))


def linear_decay(x: Column, n: int) -> Column:
    """Mean with weights 1 to n, the newest heaviest."""
    total = n * (n + 1) / 2
    if n <= 10:
        parts = [F.lag(x, k).over(history()) * (n - k) if k else x * n for k in range(n)]
        value = parts[0]
        for p in parts[1:]:
            value = value + p
        return value / total
    weighted = F.zip_with(_held(x, n), F.sequence(F.lit(1), F.lit(n)), lambda v, k: v * k)
    return full(x, n, F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v) / total)


def change_flag(x: Column) -> Column:
    """1 where a run of equal values begins: at a missing value, after one, and at a change."""
    last = F.lag(x, 1).over(history())
    return F.when(x.isNull() | last.isNull() | (x != last), 1).otherwise(0)


def forward_fill(x: Column, otherwise: float | None = None) -> Column:
    """The last positive value up to now."""
    value = F.last(F.when(x > 0, x), ignorenulls=True).over(running())
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def mean_of_at_least(x: Column, n: int, least: int) -> Column:
    w = trailing(n)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def growth(change: Column) -> Column:
    """Running product of 1 + change; missing changes count as none."""
    return F.product(1 + F.coalesce(change, F.lit(0.0))).over(running())


def drawdown(value: Column) -> Column:
    return value / F.max(value).over(running()) - 1


def volatility(close: Column, change: Column, n: int) -> Column:
    """Yearly deviation of changes over n sessions."""
    return ts_std_dev(change, n) * (252**0.5)


def atr(true_range: Column, n: int = 14) -> Column:
    return ts_mean(true_range, n)


