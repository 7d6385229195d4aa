"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def stable(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines; the nudge keeps decimal ties off the rounding edge."""
    value = F.col(col) if isinstance(col, str) else col
    return F.round(value + F.lit(float(f"1.3e-{digits + 2}")), digits)


def stable_sql(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + 1.3e-{digits + 2}, {digits})"


def with_stable(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: stable(c, digits) for c in columns})
