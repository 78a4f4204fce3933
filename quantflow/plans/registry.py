"""Registry of named queries: Spark builder + (optional) DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, bench: bool = False,
             dates: tuple[str, ...] = ("date",)):
    """``dates``: DATE columns of the oracle output, emitted as ISO text like the Spark side."""
    from quantflow.plans.util import iso_dates

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, iso_dates(sql, dates) if sql else None, bench)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the catalog modules fills REGISTRY.
    from quantflow.plans import (  # noqa: F401
        q_features, q_stats, q_execution, q_ledger, q_backtest, q_tables, q_streams, q_ml)
    return REGISTRY
