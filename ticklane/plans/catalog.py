"""Registry of the runnable queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.sources.market import Market

QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
SQL: dict[str, str] = {}

_markets: dict[tuple[str, str], Market] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Market], DataFrame]):
        add(name, build, sql)
        return build

    return register


def add(name: str, build: Callable[[Market], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def market(spark: SparkSession, folder: str) -> Market:
    """One market per application and folder, so that queries share the persisted bar table."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _markets:
        _markets[key] = Market(spark, folder)
    return _markets[key]


def release() -> None:
    """Drop the persisted tables of all markets."""
    for one in _markets.values():
        one.release()
    _markets.clear()


def rounded(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    result = F.round(value, digits) + F.lit(0.0)
    return result.alias(name or column) if (name or isinstance(column, str)) else result


def date_text(name: str = "date") -> Column:
    return F.col(name).cast("string").alias(name)
