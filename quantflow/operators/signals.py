"""Rule and probability signals, next-bar targets (SIG1-3, SIG6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantflow import params as P
from quantflow.operators.features import symbol_window


def rule_avg(price: str = "close", window: int = P.RULE_WINDOW, key="symbol",
             order="date") -> Column:
    """Mean of the last ``window`` prices, current included, summed oldest first.

    Written as an explicit left-to-right sum of lags so the float result is bit-identical
    to a sequential ``sum(...) / W``; the BUY/SELL/HOLDING split depends on exact equality.
    """
    w = symbol_window(key, order)
    total = None
    for k in range(window - 1, -1, -1):
        term = F.lag(price, k).over(w) if k else F.col(price)
        total = term if total is None else total + term
    return total / F.lit(float(window))


def rule_signal(features: DataFrame, window: int = P.RULE_WINDOW, price: str = "close",
                key: str = "symbol", order: str = "date") -> DataFrame:
    """SIG1: no signal until ``window`` rows; close >/</== mean -> BUY/SELL/HOLDING."""
    avg = rule_avg(price, window, key, order)
    n = F.row_number().over(symbol_window(key, order))
    sig = (F.when(n < window, F.lit(None).cast("string"))
           .when(F.col(price) > avg, "BUY")
           .when(F.col(price) < avg, "SELL")
           .otherwise("HOLDING"))
    return features.withColumn("signal", sig)


def next_bar_target(features: DataFrame, ret: str = "Return_1d", key="symbol",
                    order="date") -> DataFrame:
    """SIG2: Target = next row's return > 0 (last row 0)."""
    nxt = F.lead(ret).over(symbol_window(key, order))
    return features.withColumn("Target", F.coalesce(nxt > 0, F.lit(False)).cast("int"))


def pipeline_target(features: DataFrame, price: str = "close", key="symbol",
                    order="date") -> DataFrame:
    """SIG3: rows with any NULL dropped first, then next close-to-close change > 0."""
    clean = features.na.drop()
    w = symbol_window(key, order)
    nxt = F.lead(price).over(w)
    chg = F.try_divide(nxt, F.col(price)) - 1
    return clean.withColumn("Target", F.coalesce(chg > 0, F.lit(False)).cast("int"))


def probability_signal(df: DataFrame, prob: str = "prob_up",
                       min_confidence: float = P.ML_MIN_CONFIDENCE) -> DataFrame:
    """SIG6: 0 < |p| <= min_conf -> none; p > 0 -> BUY; p == 0 -> SELL."""
    p = F.col(prob)
    conf = F.abs(p)
    sig = (F.when(p.isNull(), F.lit(None).cast("string"))
           .when((conf > 0) & (conf <= min_confidence), F.lit(None).cast("string"))
           .when(p > 0, "BUY")
           .otherwise("SELL"))
    return df.withColumn("signal", sig)
