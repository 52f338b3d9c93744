"""Registry of runnable queries: a Spark plan per name, and its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.plans.tables import Tables, with_adapters

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register ``f(tables)`` under ``name``; ``sql`` may use the adapter names."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder))

        PLANS[name] = run
        if sql is not None:
            CHECKS[name] = with_adapters(sql)
        return f

    return register


def r6(value) -> Column:
    """Six decimals, and no negative zero."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col, 6) + F.lit(0.0)


def q6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def load() -> None:
    """Import every module that registers queries."""
    from basinlens.plans import (  # noqa: F401
        impact_queries,
        pixel_queries,
        record_queries,
        registry_queries,
        scoring_queries,
        source_queries,
        spatial_queries,
        stream_queries,
    )
