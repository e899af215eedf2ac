"""Scalar expressions. Missing is NULL; NaN and infinities become NULL at the boundary of a panel."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a double, as doubles where that surely gives the same: a whole number of units under 2**52, and no tie within
    the error of the product. All else takes the decimal way, which costs about ten times as much."""
    unit = F.lit(float(10**digits))
    y = x * unit
    sure = (F.abs(y) < float(2**52)) & (F.abs(y - F.floor(y) - 0.5) > F.abs(y) * 1e-15 + 1e-6)
    return F.when(sure, F.rint(y) / unit + 0.0).otherwise(F.round(x, digits))


def finite(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    return F.when(is_finite(x), x)


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """a / b; a zero divisor gives NULL."""
    return F.try_divide(a, b)


def power(a: Column, b: Column) -> Column:
    """a ** b; what is no finite number gives NULL."""
    return finite(F.pow(a, b))


def log(x: Column) -> Column:
    """Natural logarithm; zero and negative numbers give NULL."""
    return F.when(x > 0, F.log(x))


def greater(a: Column, b: Column) -> Column:
    """Comparison that is false where a side is missing."""
    return F.coalesce(a > b, F.lit(False))


def unequal(a: Column, b: Column) -> Column:
    """Comparison that is true where a side is missing."""
    return F.coalesce(a != b, F.lit(True))


def if_else(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


def larger(a: Column, b: Column) -> Column:
    """The larger of two; missing if one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def true_range(high: Column, low: Column, last_close: Column) -> Column:
    """The widest of the day's range and its distances to the last close; missing if one part is."""
    return larger(larger(high - low, F.abs(high - last_close)), F.abs(low - last_close))


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3


def dotted_ticker(ticker: Column) -> Column:
    """Upper case, share classes after a full stop."""
    return F.regexp_replace(F.upper(F.trim(ticker)), "-", ".")


def utc_instant(wall: Column) -> Column:
    """A time without a zone as the instant that it names in UTC, whatever the session's zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, wall.cast("timestamp_ntz")))


def utc_date(instant: Column) -> Column:
    """The date of an instant in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86_400).cast("int"))


def padded_id(number: Column, width: int = 10) -> Column:
    return F.lpad(F.trim(number.cast("string")), width, "0")


def plain_unit(unit: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(unit), " ", ""))


def security_type(name: Column, markers: dict[str, str]) -> Column:
    """The first type whose pattern the name matches, else COMMON_STOCK."""
    out = None
    for kind, pattern in markers.items():
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise("COMMON_STOCK") if out is not None else F.lit("COMMON_STOCK")


def class_suffix(ticker: Column) -> Column:
    """The letter after the last full stop or hyphen; NULL if there is none."""
    return F.nullif(F.regexp_extract(ticker, r"[.-]([A-Z])$", 1), F.lit(""))


def clean_label(label: Column, empty: tuple[str, ...] = ("", "none", "nan", "null", "n/a")) -> Column:
    """Trimmed label; words for nothing give NULL."""
    plain = F.trim(label)
    return F.when(~F.lower(plain).isin(*empty), plain)


def acceptance(text: Column) -> Column:
    """A filing time, as fourteen digits or as an ISO time; naive times are UTC."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(text))


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def identity(*columns: Column) -> Column:
    """A stable SHA-256 name of some values."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def iso_week(day: Column) -> Column:
    """ISO year and week as one number."""
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def reasons(tests: dict[str, Column]) -> Column:
    """An array of the names whose test is true, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items())))


def first_reason(tests: dict[str, Column], otherwise: str | None = None) -> Column:
    """The first name whose test is true."""
    out = reduce(lambda w, kt: w.when(kt[1], kt[0]) if w is not None else F.when(kt[1], kt[0]), tests.items(), None)
    return out.otherwise(F.lit(otherwise))
