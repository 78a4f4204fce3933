"""Report datasets: the data behind the reference's charts (RPT*). Drawing is not built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantflow.functions.exprs import round_even

from quantflow.operators import stats as ST

HIST_BINS = 50
BOX_PCTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def price_pivot(bars: DataFrame, symbols: Sequence, key: str = "symbol",
                order: str = "date", value: str = "close") -> DataFrame:
    """RPT1: date x symbol matrix of the mean close, one column for each of ``symbols``.

    The list bounds the output's width and saves a job that looks for the values; the bars
    themselves are the long form, whatever the number of symbols."""
    return bars.groupBy(order).pivot(key, list(symbols)).agg(F.avg(value))


def equity_wide(equity: DataFrame, series: Sequence, key: str = "series", order: str = "date",
                value: str = "equity", exclude: str = "account") -> DataFrame:
    """RPT1b: date-aligned equity of ``series`` (outer alignment on date), account excluded."""
    e = equity.where(F.col(key) != F.lit(exclude))
    return e.groupBy(order).pivot(key, list(series)).agg(F.max(value))


def daily_and_cum_pnl(equity: DataFrame, keys="series", order: str = "date",
                      value: str = "equity") -> DataFrame:
    """RPT2: daily PnL and its running sum per series."""
    ks = ST.series_keys(keys)
    d = ST.daily_pnl(equity, ks, order, value)
    w = Window.partitionBy(*ks).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cum_pnl", F.sum("pnl").over(w))


def drawdown_pct(equity: DataFrame, keys="series", order: str = "date",
                 value: str = "equity") -> DataFrame:
    """RPT3: drawdown in percent."""
    ks = ST.series_keys(keys)
    d = ST.drawdown(equity, ks, order, value)
    return d.select(*ks, order, (F.col("drawdown") * 100).alias("drawdown_pct"))


def pnl_histogram(pnl: DataFrame, keys="series", value: str = "pnl",
                  bins: int = HIST_BINS) -> DataFrame:
    """RPT6: equal-width bins over the global PnL range, counts per series and bin.

    The range is one global aggregate (a single row, so broadcasting it is size-safe); the
    maximum itself is folded into the last bin.
    """
    ks = ST.series_keys(keys)
    rng = pnl.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    b = F.least(F.width_bucket(F.col(value), F.col("__lo"), F.col("__hi"), F.lit(bins)),
                F.lit(bins)).cast("bigint")
    return (pnl.crossJoin(F.broadcast(rng))
            .groupBy(*ks, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def pnl_box(pnl: DataFrame, keys="series", value: str = "pnl") -> DataFrame:
    """RPT6 box: exact quartiles per series (a series is bounded by its number of dates)."""
    ks = ST.series_keys(keys)
    q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in BOX_PCTS]))
    out = pnl.groupBy(*ks).agg(q.alias("__q"))
    names = ["p0", "p25", "p50", "p75", "p100"]
    return out.select(*ks, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def price_with_trades(bars: DataFrame, trades: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """RPT5: close per symbol and date with trade markers; trade price and PnL rounded 2."""
    t = trades.select(*keys, "direction", round_even("price", 2).alias("trade_price"), "quantity",
                      round_even("realized_pnl", 2).alias("realized_pnl"))
    return bars.select(*keys, "close").join(t, list(keys), "left")


def win_loss(trades: DataFrame, pnl: str = "realized_pnl", key: str = "symbol",
             sells_only: bool = False) -> DataFrame:
    """RPT7: count of Win (pnl > 0) / Loss (<= 0) trade records per symbol.

    Default: every record, BUY rows included, on the cumulative PnL (the reference's
    chart). ``pnl="trade_pnl", sells_only=True`` counts closed trades by their own PnL."""
    if sells_only:
        trades = trades.where(F.col("direction") == "SELL")
    res = F.when(F.col(pnl) > 0, "Win").otherwise("Loss")
    return trades.groupBy(key, res.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def symbol_contribution(trades: DataFrame, pnl: str = "realized_pnl",
                        key: str = "symbol") -> DataFrame:
    """RPT9: sum of trade-record PnL per symbol, largest first."""
    return (trades.groupBy(key).agg(F.sum(pnl).alias("pnl"))
            .orderBy(F.col("pnl").desc(), F.col(key)))
