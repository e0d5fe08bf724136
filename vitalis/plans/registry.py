"""Query registry shared by the query modules (``q_*.py``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalis import ship_package
from vitalis.functions.columns import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame with its optional DuckDB oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def out(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Comparison rounding of every double column."""
    return round_doubles(df, digits, overrides)
