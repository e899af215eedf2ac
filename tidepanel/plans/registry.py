"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(run: Query) -> Query:
        add(name, run, sql)
        return run

    return put


def rounded(x: Column, digits: int = 6) -> Column:
    """Doubles are compared after rounding; adding zero turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)
