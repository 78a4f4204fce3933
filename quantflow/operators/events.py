"""Typed event log and filters (FLT*).

The reference routes objects through an in-process bus; here one log table carries an
``event_type`` column and each consumer is a filter on it (no bus, no queue).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow import params as P


def drop_empty(df: DataFrame, type_col: str = "event_type", ts_col: str = "ts") -> DataFrame:
    """FLT1 / RSK4 empty check: an event with a NULL type or timestamp is dropped."""
    return df.where(F.col(type_col).isNotNull() & F.col(ts_col).isNotNull())


def event_log(parts: Mapping[str, DataFrame]) -> DataFrame:
    """FLT2: one log from typed frames (``unionByName`` with missing columns as NULL)."""
    out = None
    for etype, df in parts.items():
        if etype not in P.EVENT_TYPES:
            raise ValueError(f"unknown event type {etype}")
        tagged = df.withColumn("event_type", F.lit(etype))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def route(log: DataFrame, *event_types: str) -> DataFrame:
    """FLT2: the view of the log a consumer of ``event_types`` sees."""
    return log.where(F.col("event_type").isin(list(event_types)))


def zero_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """FLT4: 0 -> NULL ahead of returns (never Spark NaN)."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols})


def dropna_series(df: DataFrame, value: str) -> DataFrame:
    """FLT5: drop NULL points of a (key, date, value) series."""
    return df.where(F.col(value).isNotNull())


def nonzero(df: DataFrame, value: str) -> DataFrame:
    """FLT3."""
    return df.where(F.col(value) != 0)


def signals_from_log(log: DataFrame, strategy=None) -> DataFrame:
    """FLT6: a strategy consumes FEATURE rows only; other event types yield no signal."""
    from quantflow.operators.signals import rule_signal
    feats = route(log, "FEATURE")
    strategy = strategy or (lambda f: rule_signal(f))
    return strategy(feats).where(F.col("signal").isNotNull())
