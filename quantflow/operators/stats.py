"""Performance statistics over equity curves (STA*).

Input: ``equity(<keys...>, date, equity)`` with one row per key and date. Every statistic
takes the key columns, so one pass serves the account curve and every symbol curve (and,
in a sweep, every account). Returns are computed once (STA1) and reused.

Windows are partitioned by the series key: a series has at most one row per date, so a
window partition is bounded by the calendar, whatever the data volume.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflow.functions.exprs import round_even

from quantflow import params as P

SQRT_YEAR = math.sqrt(P.PERIODS_PER_YEAR)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _w(keys, order="date"):
    return Window.partitionBy(*_keys(keys)).orderBy(order)


def _cum(keys, order="date"):
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def daily_returns(equity: DataFrame, keys="series", order: str = "date",
                  value: str = "equity", raw: bool = False) -> DataFrame:
    """STA1: e / prev - 1, first row 0, rounded half-even to 4 decimals (Q7).

    NULL equity points are dropped first (FLT5); a zero previous value gives NULL (Q9).
    """
    e = equity.where(F.col(value).isNotNull())
    prev = F.lag(value).over(_w(keys, order))
    r = F.when(prev.isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col(value), prev) - 1)
    return e.withColumn("ret", r if raw else round_even(r, P.DECIMALS))


def daily_pnl(equity: DataFrame, keys="series", order: str = "date",
              value: str = "equity") -> DataFrame:
    """STA2: equity difference (first point dropped), summed per calendar date."""
    ks = _keys(keys)
    d = equity.withColumn("pnl", F.col(value) - F.lag(value).over(_w(ks, order)))
    d = d.where(F.col("pnl").isNotNull())
    return d.groupBy(*ks, F.to_date(order).alias(order)).agg(F.sum("pnl").alias("pnl"))


def drawdown(equity: DataFrame, keys="series", order: str = "date",
             value: str = "equity") -> DataFrame:
    """STA8: e / running max - 1."""
    peak = F.max(value).over(_cum(keys, order))
    return equity.withColumn("drawdown", F.try_divide(F.col(value), peak) - 1)


def cumulative_returns(returns: DataFrame, keys="series", order: str = "date") -> DataFrame:
    """STA6: running product of (1 + r) minus 1, rounded 4."""
    cp = F.product(F.lit(1.0) + F.col("ret")).over(_cum(keys, order)) - 1
    return returns.withColumn("cum_return", round_even(cp, P.DECIMALS))


def _dd_columns(equity: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Per row: drawdown and the first date at which the running peak was reached."""
    cum = _cum(keys, order)
    peak = F.max(F.struct(F.col(value).alias("v"),
                          (-F.unix_date(F.to_date(order))).alias("neg_day"))).over(cum)
    return (equity.withColumn("__peak", peak)
            .withColumn("drawdown", F.try_divide(F.col(value), F.col("__peak.v")) - 1)
            .withColumn("__peak_day", -F.col("__peak.neg_day")))


def max_drawdown(equity: DataFrame, keys="series", order: str = "date",
                 value: str = "equity") -> DataFrame:
    """STA7: min drawdown (rounded 4) and days from the first peak to the first trough."""
    ks = _keys(keys)
    d = _dd_columns(equity, ks, order, value)
    trough = F.min_by(F.struct(F.col("drawdown").alias("dd"),
                               F.unix_date(F.to_date(order)).alias("day"),
                               F.col("__peak_day").alias("peak_day")),
                      F.struct(F.col("drawdown"), F.col(order)))
    agg = d.groupBy(*ks).agg(trough.alias("__t"))
    return agg.select(*ks, round_even(F.col("__t.dd"), P.DECIMALS).alias("max_dd"),
                      F.greatest(F.col("__t.day") - F.col("__t.peak_day"), F.lit(0))
                      .cast("bigint").alias("max_dd_duration"))


def ratio_aggs(ret: str = "ret", rf: float = 0.0) -> dict[str, Column]:
    """Aggregate expressions over a (rounded) returns column: STA3, STA4, STA5, STA12."""
    r = F.col(ret)
    excess = r - F.lit(rf / P.PERIODS_PER_YEAR)
    n = F.count(r)
    total = F.product(F.lit(1.0) + r) - 1
    return {
        "sharpe": round_even(F.try_divide(F.avg(excess), F.stddev_samp(excess)) * F.lit(SQRT_YEAR),
                           P.DECIMALS),
        "volatility": round_even(F.stddev_samp(r) * F.lit(SQRT_YEAR), P.DECIMALS),
        "annual_return": round_even(F.pow(F.lit(1.0) + total,
                                        F.lit(float(P.PERIODS_PER_YEAR)) / n) - 1, P.DECIMALS),
        "sortino": F.try_divide(F.lit(SQRT_YEAR) * F.avg(r),
                                F.stddev_pop(F.when(r < 0, r))),
    }


def summary(equity: DataFrame, keys="series", order: str = "date",
            value: str = "equity") -> DataFrame:
    """STA14: one row per series with every scalar statistic; one grouped aggregation.

    ``total_return`` is the last value of the cumulative-return series (Q8).
    """
    ks = _keys(keys)
    r = daily_returns(equity, ks, order, value)
    d = _dd_columns(r, ks, order, value)
    trough = F.min_by(F.struct(F.col("drawdown").alias("dd"),
                               F.unix_date(F.to_date(order)).alias("day"),
                               F.col("__peak_day").alias("peak_day")),
                      F.struct(F.col("drawdown"), F.col(order)))
    aggs = ratio_aggs("ret")
    out = d.groupBy(*ks).agg(
        aggs["sharpe"].alias("sharpe"), aggs["volatility"].alias("volatility"),
        aggs["annual_return"].alias("annual_return"),
        round_even(F.product(F.lit(1.0) + F.col("ret")) - 1, P.DECIMALS).alias("total_return"),
        trough.alias("__t"), F.count(F.lit(1)).alias("n_points"))
    return out.select(*ks, "annual_return", "volatility", "sharpe",
                      round_even(F.col("__t.dd"), P.DECIMALS).alias("max_dd"),
                      F.greatest(F.col("__t.day") - F.col("__t.peak_day"), F.lit(0))
                      .cast("bigint").alias("max_dd_duration"),
                      "total_return", "n_points")


def metric_series(equity: DataFrame, keys="series", order: str = "date", value: str = "equity") -> DataFrame:
    """STA14's series in long form (keys, date, metric, value): ``equity``, ``returns``,
    ``total_return`` (cumulative) and ``daily_pnl``, from one window pass over the curves that
    is unpivoted afterwards. NULL equity points are left out; the first has no ``daily_pnl``."""
    ks = _keys(keys)
    r = daily_returns(equity.select(*ks, order, value), ks, order, value)
    r = cumulative_returns(r, ks, order).withColumn("pnl", F.col(value) - F.lag(value).over(_w(ks, order)))
    metric = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
    return r.select(*ks, order, F.inline(F.array(
        metric("equity", value), metric("returns", "ret"), metric("total_return", "cum_return"),
        metric("daily_pnl", "pnl")))).where((F.col("metric") != "daily_pnl") | F.col("value").isNotNull())


def stats_table(summ: DataFrame, key: str = "series") -> DataFrame:
    """STA15: display projection of the summary."""
    return summ.select(F.col(key).alias("Symbol"), F.col("annual_return").alias("Annual Return"),
                       F.col("volatility").alias("Volatility"), F.col("sharpe").alias("Sharpe"),
                       F.col("max_dd").alias("Max DD"),
                       F.col("max_dd_duration").alias("Max DD Duration"))


def aggregate_returns(returns: DataFrame, convert_to: str, keys="series",
                      order: str = "date") -> DataFrame:
    """STA10: compounded returns by (year, month, ISO week) / (year, month) / (year)."""
    ks = _keys(keys)
    d = F.to_date(order)
    groups = {"weekly": [F.year(d).alias("year"), F.month(d).alias("month"),
                         F.weekofyear(d).alias("week")],
              "monthly": [F.year(d).alias("year"), F.month(d).alias("month")],
              "yearly": [F.year(d).alias("year")]}
    if convert_to not in groups:
        raise ValueError(f"unknown period {convert_to!r}: choose one of {sorted(groups)}")
    return returns.groupBy(*ks, *groups[convert_to]).agg(
        (F.product(F.lit(1.0) + F.col("ret")) - 1).alias("ret"))


def monthly_returns(returns: DataFrame, keys="series", order: str = "date",
                    decimals: int = 2) -> DataFrame:
    """STA9 long form: (keys, year, month, ret) for every calendar month inside each series'
    range; a month with no rows inside the range compounds nothing (0.0).

    The month calendar per series is generated from (min, max) with ``sequence`` — at most
    one row per month per series — and left-joined to the compounded months.
    """
    ks = _keys(keys)
    m = F.trunc(F.to_date(order), "month")
    per_month = returns.groupBy(*ks, m.alias("month_start")).agg(
        F.product(F.lit(1.0) + F.col("ret")).alias("__g"))
    bounds = returns.groupBy(*ks).agg(F.min(m).alias("__lo"), F.max(m).alias("__hi"))
    cal = bounds.select(*ks, F.explode(F.sequence("__lo", "__hi", F.expr("INTERVAL 1 MONTH")))
                        .alias("month_start"))
    j = cal.join(per_month, ks + ["month_start"], "left")
    return j.select(*ks, F.year("month_start").alias("year"),
                    F.month("month_start").alias("month"),
                    round_even(F.coalesce(F.col("__g") - 1, F.lit(0.0)), decimals).alias("ret"))


def monthly_matrix(returns: DataFrame, keys="series", order: str = "date") -> DataFrame:
    """STA9: pivot (keys, Year) x Jan..Dec with explicit pivot values (no extra pass)."""
    ks = _keys(keys)
    lm = monthly_returns(returns, ks, order)
    names = F.element_at(F.array(*[F.lit(x) for x in P.MONTHS]), F.col("month"))
    return (lm.withColumn("mname", names)
            .groupBy(*ks, F.col("year").alias("Year"))
            .pivot("mname", P.MONTHS).agg(F.first("ret")))


def cagr(equity: DataFrame, keys="series", order: str = "date", value: str = "equity",
         normalise: bool = False) -> DataFrame:
    """STA11: last ** (252 / n) - 1, rounded 4. The formula assumes a curve that starts at 1;
    ``normalise`` divides any other by its first value."""
    ks = _keys(keys)
    last = F.max_by(value, order)
    first = F.min_by(value, order)
    level = F.try_divide(last, first) if normalise else last
    return equity.groupBy(*ks).agg(
        round_even(F.pow(level, F.lit(float(P.PERIODS_PER_YEAR)) / F.count(value)) - 1,
                 P.DECIMALS).alias("cagr"))


def sortino(returns: DataFrame, keys="series") -> DataFrame:
    """STA12: sqrt(252) * mean(r) / population std of the negative returns."""
    ks = _keys(keys)
    return returns.groupBy(*ks).agg(ratio_aggs("ret")["sortino"].alias("sortino"))


def rolling_sharpe(returns: DataFrame, window: int = 30, keys="series",
                   order: str = "date") -> DataFrame:
    """RPT8: rolling mean / std of returns (not annualised), NULL until ``window`` rows."""
    w = _w(keys, order).rowsBetween(-(window - 1), Window.currentRow)
    rs = F.when(F.count("ret").over(w) >= window,
                F.try_divide(F.avg("ret").over(w), F.stddev_samp("ret").over(w)))
    return returns.withColumn("rolling_sharpe", rs)


def with_series_union(account: DataFrame, symbols: DataFrame, account_name: str = "account",
                      sym_col: str = "symbol") -> DataFrame:
    """STA14 input: account curve and per-symbol curves as one keyed table."""
    a = account.select(F.lit(account_name).alias("series"), "date", "equity")
    s = symbols.select(F.col(sym_col).cast("string").alias("series"), "date", "equity")
    return a.unionByName(s)


def series_keys(keys: Sequence[str] | str) -> list[str]:
    return _keys(keys)
