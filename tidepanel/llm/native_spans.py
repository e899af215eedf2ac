"""Places of regular-expression matches as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Enough doublings for 2**26 matches in one text.
_DOUBLINGS = 26
_BEGIN, _END, _OTHER = "\x01", "\x02", "\x03"


def bound(value: Column, use) -> Column:
    """``use(x)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column) -> Column:
    """Running sums of an array of numbers by doubling steps; steps beyond its length are skipped."""
    def doubled(step: int):
        return lambda v: F.when(F.size(v) > step, F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i - step), F.lit(0).cast("long")))).otherwise(v)

    for k in range(_DOUBLINGS):
        values = bound(values, doubled(1 << k))
    return values


def matches(text: Column, pattern: str | Column) -> Column:
    """Leftmost matches that do not overlap: structs (start, end, text) in code points, the end exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    plain = F.regexp_replace(text, f"[{_BEGIN}{_END}]", _OTHER)
    marked = F.regexp_replace(plain, pattern, F.lit(f"{_BEGIN}$0{_END}"))

    def found(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, lambda p: F.length(p).cast("long")))
        # before match i stand i + 1 pieces, which hold i closing marks
        rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return bound(ends, lambda e: F.transform(rest, lambda p, i: _struct(F.get(e, i) - i, F.substring_index(p, _END, 1))))

    return bound(F.split(marked, _BEGIN), found)


def _struct(start: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))
