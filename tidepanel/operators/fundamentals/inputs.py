"""Several fundamental inputs on one grid, and factors over them.

A panel has session, security_id, field, basis, mode, grade and value: what was known of each field at each session.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.factor import Factor, evaluate, fields_of
from tidepanel.operators.gates import HISTORICAL
from tidepanel.sources.panels import densify

PROXY = "HYPOTHESIS_PROXY"


@dataclass(frozen=True)
class Binding:
    """One field on one basis; ``proxy`` lets values in that only stand in for it."""

    field: str
    basis: str
    proxy: bool = False

    @property
    def alias(self) -> str:
        return f"{self.field}__{self.basis}"


def _checked(bindings: Sequence[Binding]) -> None:
    aliases = [b.alias for b in bindings]
    if not aliases:
        raise ValueError("INPUT_BINDINGS_EMPTY")
    repeated = sorted({a for a in aliases if aliases.count(a) > 1})
    if repeated:
        raise ValueError(f"INPUT_ALIAS_DUPLICATE: {', '.join(repeated)}")


def panel_rows(panel: DataFrame, bindings: Sequence[Binding], mode: str = HISTORICAL, start=None, end=None) -> DataFrame:
    """Rows of one mode and window that some binding asks for; proxies only where the binding takes them.

    All tests are on columns of the panel, so they reach its scan.
    """
    _checked(bindings)
    real = F.coalesce(F.col("grade") != PROXY, F.lit(False))
    wanted = reduce(lambda a, b: a | b, ((F.col("field") == b.field) & (F.col("basis") == b.basis) & (F.lit(b.proxy) | real) for b in bindings))
    rows = panel.where((F.col("mode") == mode) & wanted)
    rows = rows if start is None else rows.where(F.col("session") >= start)
    return rows if end is None else rows.where(F.col("session") <= end)


def aligned(panel: DataFrame, bindings: Sequence[Binding], calendar: DataFrame, mode: str = HISTORICAL, start=None, end=None) -> DataFrame:
    """The grid of the calendar's sessions and all securities that any input has, a column for each binding's alias.

    One group-by makes all columns. A cell without a value is NULL; two values for one cell are an error, as neither is right.
    """
    rows = panel_rows(panel, bindings, mode, start, end)

    def cell(b: Binding):
        here = (F.col("field") == b.field) & (F.col("basis") == b.basis)
        twice = F.raise_error(F.lit(f"INPUT_DUPLICATE_CELL: {b.alias}")).cast("double")
        return F.when(F.count_if(here) > 1, twice).otherwise(F.max(F.when(here, F.col("value")))).alias(b.alias)

    wide = rows.groupBy("session", "security_id").agg(*map(cell, bindings))
    sessions = calendar.select("session")
    sessions = sessions if start is None else sessions.where(F.col("session") >= start)
    sessions = sessions if end is None else sessions.where(F.col("session") <= end)
    return densify(wide, sessions, rows.select("security_id"))


def evaluated(grid: DataFrame, bindings: Sequence[Binding], factors: list[Factor], strict: bool = True) -> DataFrame:
    """Factors over aligned inputs (session, security_id, a column for each factor).

    Each factor must read inputs that are bound; a ``strict`` run takes no input that admits proxies.
    """
    _checked(bindings)
    aliases = {b.alias for b in bindings}
    for f in factors:
        unknown = sorted(fields_of(f.expression) - aliases)
        if unknown:
            raise ValueError(f"INPUT_SET_MISMATCH: {f.name} reads {', '.join(unknown)}")
        proxies = sorted(b.alias for b in bindings if b.proxy and b.alias in fields_of(f.expression))
        if strict and proxies:
            raise ValueError(f"STRICT_PROXY_INPUT: {f.name} reads {', '.join(proxies)}")
    return evaluate(grid, factors)
