"""Order pricing and execution (EXE*, JOIN1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantflow import params as P
from quantflow.functions.exprs import slipped_price


def asof_price(orders: DataFrame, bars: DataFrame, key: str = "symbol", order: str = "date",
               price: str = "close", out_price: str = "market_price",
               out_date: str = "bar_date") -> DataFrame:
    """JOIN1: price each order with the latest bar of its symbol at or before its date
    (same date included). Orders with no earlier bar get NULL (rejected downstream).

    Skew-safe plan: the as-of search runs on the *distinct* (symbol, date) keys of the
    orders, never on the order rows, so a symbol holding a third of all orders still
    contributes only one row per date to the window. The matched keys are then equi-joined
    back to the orders on (symbol, date); AQE splits a skewed side of that join.
    """
    keys = orders.select(key, order).distinct()
    b = bars.select(key, order, F.struct(F.col(order).alias("d"), F.col(price).alias("p"))
                    .alias("__bar"), F.lit(0).alias("__k"))
    k = keys.select(key, order, F.lit(None).cast(b.schema["__bar"].dataType).alias("__bar"),
                    F.lit(1).alias("__k"))
    w = (Window.partitionBy(key).orderBy(order, "__k")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = (b.unionByName(k)
               .withColumn("__m", F.last("__bar", ignorenulls=True).over(w))
               .where(F.col("__k") == 1)
               .select(key, order, F.col("__m.p").alias(out_price),
                       F.col("__m.d").alias(out_date)))
    return orders.join(matched, [key, order], "left")


def execute_orders(priced: DataFrame, slippage: float = P.SLIPPAGE,
                   market: str = "market_price") -> DataFrame:
    """EXE1-3: every order with ``fill_price`` (NULL when not filled) and ``reject_reason``.

    MKT fills at market +/- slippage by direction; LIMIT BUY fills at the limit when the
    market is at or below it, LIMIT SELL when at or above; unknown types never fill.
    """
    ot, d = F.col("order_type"), F.col("direction")
    m, lim = F.col(market), F.col("limit_price")
    reason = (F.when(m.isNull(), "no_price")
              .when(~ot.isin("MKT", "LIMIT"), "unknown_order_type")
              .when((ot == "LIMIT") & (d == "BUY") & (m > lim), "limit_buy_above_limit")
              .when((ot == "LIMIT") & (d == "SELL") & (m < lim), "limit_sell_below_limit"))
    fill = (F.when(reason.isNotNull(), F.lit(None).cast("double"))
            .when(ot == "MKT", slipped_price(m, d, slippage))
            .otherwise(lim))
    return priced.withColumn("reject_reason", reason).withColumn("fill_price", fill)


def fills_and_rejects(executed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EXE3 / BKT4: the two outputs of execution."""
    return (executed.where(F.col("reject_reason").isNull()),
            executed.where(F.col("reject_reason").isNotNull()))


def rejects_report(rejects: DataFrame, reason: str = "reject_reason",
                   keys: Sequence[str] = ()) -> DataFrame:
    """BKT4: blocked orders/signals counted by reason."""
    return rejects.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
