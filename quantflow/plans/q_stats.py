"""Registered queries: performance statistics and equity report datasets (STA*, RPT1-4/6/8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantflow.functions.exprs import round_even

from quantflow import params as P
from quantflow.operators import ledger as LG
from quantflow.operators import reports as RP
from quantflow.operators import stats as ST
from quantflow.plans.oracle_views import BARS_EV, EQUITY_ORD
from quantflow.plans.q_ledger import EQUITY_SQL, _closes, _eod
from quantflow.plans.registry import register
from quantflow.plans.util import rounded
from quantflow.sources import fixtures as FX

SQRT = repr(math.sqrt(P.PERIODS_PER_YEAR))

RET_SQL = EQUITY_ORD + """,
ret AS (
  SELECT series, date, equity,
         round_even(CASE WHEN lag(equity) OVER w IS NULL THEN 0.0
                         ELSE equity / NULLIF(lag(equity) OVER w, 0) - 1 END, 4) AS ret
  FROM equity_ord WHERE equity IS NOT NULL
  WINDOW w AS (PARTITION BY series ORDER BY date))"""

DD_SQL = """dd AS (
  SELECT *, equity / NULLIF(max(equity) OVER c, 0) - 1 AS drawdown,
         -(max({'v': equity, 'nd': -date_diff('day', DATE '1970-01-01', date)}) OVER c).nd AS peak_day
  FROM ret WINDOW c AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
trough AS (
  SELECT series,
         arg_min({'dd': drawdown, 'day': date_diff('day', DATE '1970-01-01', date), 'peak_day': peak_day},
                 (drawdown, date)) AS t
  FROM dd GROUP BY series)"""


def _eq(spark, sf_dir):
    return FX.equity_ord(spark, sf_dir)


def _ret(spark, sf_dir):
    return ST.daily_returns(_eq(spark, sf_dir))


@register("sta1_daily_returns", f"WITH {RET_SQL} SELECT series, date, ret FROM ret")
def sta1(spark, sf_dir):
    return rounded(_ret(spark, sf_dir).select("series", "date", "ret"))


@register("sta2_daily_pnl", f"""WITH {EQUITY_ORD}
SELECT series, date, pnl FROM (
  SELECT series, date, equity - lag(equity) OVER (PARTITION BY series ORDER BY date) AS pnl
  FROM equity_ord) WHERE pnl IS NOT NULL""")
def sta2(spark, sf_dir):
    return rounded(ST.daily_pnl(_eq(spark, sf_dir)))


@register("sta3_sharpe", f"""WITH {RET_SQL}
SELECT series, round_even(avg(ret) / NULLIF(stddev_samp(ret), 0) * {SQRT}, 4) AS sharpe
FROM ret GROUP BY series""", dates=())
def sta3(spark, sf_dir):
    return _ret(spark, sf_dir).groupBy("series").agg(ST.ratio_aggs()["sharpe"].alias("sharpe"))


@register("sta4_volatility", f"""WITH {RET_SQL}
SELECT series, round_even(stddev_samp(ret) * {SQRT}, 4) AS volatility
FROM ret GROUP BY series""", dates=())
def sta4(spark, sf_dir):
    return _ret(spark, sf_dir).groupBy("series").agg(
        ST.ratio_aggs()["volatility"].alias("volatility"))


@register("sta5_annual_return", f"""WITH {RET_SQL}
SELECT series, round_even(pow(1.0 + (product(1.0 + ret) - 1), 252.0 / count(ret)) - 1, 4) AS annual_return
FROM ret GROUP BY series""", dates=())
def sta5(spark, sf_dir):
    return _ret(spark, sf_dir).groupBy("series").agg(
        ST.ratio_aggs()["annual_return"].alias("annual_return"))


@register("sta6_cumulative_returns", f"""WITH {RET_SQL}
SELECT series, date, round_even(product(1.0 + ret) OVER (PARTITION BY series ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 4) AS cum_return FROM ret""")
def sta6(spark, sf_dir):
    return rounded(ST.cumulative_returns(_ret(spark, sf_dir)).select("series", "date",
                                                                     "cum_return"))


@register("sta7_max_drawdown_duration", f"""WITH {RET_SQL}, {DD_SQL}
SELECT series, round_even(t.dd, 4) AS max_dd,
       CAST(greatest(t.day - t.peak_day, 0) AS BIGINT) AS max_dd_duration FROM trough""",
          dates=())
def sta7(spark, sf_dir):
    return ST.max_drawdown(_eq(spark, sf_dir))


@register("sta8_drawdown_series", f"""WITH {EQUITY_ORD}
SELECT series, date, equity / NULLIF(max(equity) OVER (PARTITION BY series ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1 AS drawdown FROM equity_ord""")
def sta8(spark, sf_dir):
    return rounded(ST.drawdown(_eq(spark, sf_dir)).select("series", "date", "drawdown"))


MONTHLY_SQL = RET_SQL + """,
pm AS (SELECT series, date_trunc('month', date) AS ms, product(1.0 + ret) AS g
       FROM ret GROUP BY series, date_trunc('month', date)),
bounds AS (SELECT series, min(date_trunc('month', date)) AS lo, max(date_trunc('month', date)) AS hi
           FROM ret GROUP BY series),
cal AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ms
        FROM bounds),
lm AS (SELECT c.series, CAST(year(c.ms) AS INTEGER) AS year, CAST(month(c.ms) AS INTEGER) AS month,
              round_even(coalesce(pm.g - 1, 0.0), 2) AS ret
       FROM cal c LEFT JOIN pm ON pm.series = c.series AND pm.ms = c.ms)"""

_piv = ",\n       ".join(f"max(CASE WHEN month = {i + 1} THEN ret END) AS {m}"
                       for i, m in enumerate(P.MONTHS))


@register("sta9_monthly_matrix", f"""WITH {MONTHLY_SQL}
SELECT series, year AS Year,
       {_piv}
FROM lm GROUP BY series, year""", dates=())
def sta9(spark, sf_dir):
    return ST.monthly_matrix(_ret(spark, sf_dir))


@register("sta10_aggregate_returns_weekly", f"""WITH {RET_SQL}
SELECT series, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(weekofyear(date) AS INTEGER) AS week, round_even(product(1.0 + ret) - 1, 8) AS ret
FROM ret GROUP BY 1, 2, 3, 4""", dates=())
def sta10w(spark, sf_dir):
    return rounded(ST.aggregate_returns(_ret(spark, sf_dir), "weekly"), {"ret": 8})


@register("sta10_aggregate_returns_monthly", f"""WITH {RET_SQL}
SELECT series, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       round_even(product(1.0 + ret) - 1, 8) AS ret
FROM ret GROUP BY 1, 2, 3""", dates=())
def sta10m(spark, sf_dir):
    return rounded(ST.aggregate_returns(_ret(spark, sf_dir), "monthly"), {"ret": 8})


@register("sta10_aggregate_returns_yearly", f"""WITH {RET_SQL}
SELECT series, CAST(year(date) AS INTEGER) AS year, round_even(product(1.0 + ret) - 1, 8) AS ret
FROM ret GROUP BY 1, 2""", dates=())
def sta10y(spark, sf_dir):
    return rounded(ST.aggregate_returns(_ret(spark, sf_dir), "yearly"), {"ret": 8})


@register("sta11_cagr", f"""WITH {EQUITY_ORD}
SELECT series, round_even(pow(arg_max(equity, date), 252.0 / count(equity)) - 1, 4) AS cagr,
       round_even(pow(arg_max(equity, date) / NULLIF(arg_min(equity, date), 0),
                      252.0 / count(equity)) - 1, 4) AS cagr_from_first
FROM equity_ord GROUP BY series""", dates=())
def sta11(spark, sf_dir):
    eq = _eq(spark, sf_dir)
    from_first = ST.cagr(eq, normalise=True).withColumnRenamed("cagr", "cagr_from_first")
    return ST.cagr(eq).join(from_first, "series")


@register("sta12_sortino", f"""WITH {RET_SQL}
SELECT series, round_even({SQRT} * avg(ret) / NULLIF(stddev_pop(CASE WHEN ret < 0 THEN ret END), 0), 8) AS sortino
FROM ret GROUP BY series""", dates=())
def sta12(spark, sf_dir):
    return rounded(ST.sortino(_ret(spark, sf_dir)), {"sortino": 8})


@register("sta13_round4", f"""WITH {EQUITY_ORD}
SELECT series, date, r AS ret_raw, round_even(r, 4) AS ret FROM (
  SELECT series, date, CASE WHEN lag(equity) OVER w IS NULL THEN 0.0
                            ELSE equity / NULLIF(lag(equity) OVER w, 0) - 1 END AS r
  FROM equity_ord WINDOW w AS (PARTITION BY series ORDER BY date))""")
def sta13(spark, sf_dir):
    raw = ST.daily_returns(_eq(spark, sf_dir), raw=True).withColumnRenamed("ret", "ret_raw")
    return rounded(raw.select("series", "date", "ret_raw",
                              round_even("ret_raw", P.DECIMALS).alias("ret")))


SUMMARY_AGG = f"""agg AS (SELECT series,
  round_even(pow(1.0 + (product(1.0 + ret) - 1), 252.0 / count(ret)) - 1, 4) AS annual_return,
  round_even(stddev_samp(ret) * {SQRT}, 4) AS volatility,
  round_even(avg(ret) / NULLIF(stddev_samp(ret), 0) * {SQRT}, 4) AS sharpe,
  round_even(product(1.0 + ret) - 1, 4) AS total_return,
  count(*) AS n_points
  FROM ret GROUP BY series)"""
SUMMARY_SQL = f"WITH {RET_SQL}, {DD_SQL},\n{SUMMARY_AGG}"


@register("sta14_summary", SUMMARY_SQL + """
SELECT a.series, annual_return, volatility, sharpe, round_even(t.t.dd, 4) AS max_dd,
       CAST(greatest(t.t.day - t.t.peak_day, 0) AS BIGINT) AS max_dd_duration,
       total_return, n_points
FROM agg a JOIN trough t ON a.series = t.series""", dates=(), bench=True)
def sta14(spark, sf_dir):
    return ST.summary(_eq(spark, sf_dir))


@register("sta14_metric_series", f"""WITH {RET_SQL},
m AS (SELECT series, date, equity, ret, equity - lag(equity) OVER (PARTITION BY series ORDER BY date) AS pnl,
             round_even(product(1.0 + ret) OVER (PARTITION BY series ORDER BY date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 4) AS cum FROM ret)
SELECT series, date, 'equity' AS metric, equity AS value FROM m
UNION ALL SELECT series, date, 'returns', ret FROM m
UNION ALL SELECT series, date, 'total_return', cum FROM m
UNION ALL SELECT series, date, 'daily_pnl', pnl FROM m WHERE pnl IS NOT NULL""")
def sta14_series(spark, sf_dir):
    return rounded(ST.metric_series(_eq(spark, sf_dir)))


@register("sta14_account_and_symbols", f"""WITH RECURSIVE {EQUITY_SQL},
equity_ord AS (SELECT 'account' AS series, date, round_even(equity, 4) AS equity FROM eq
               UNION ALL SELECT CAST(symbol AS VARCHAR), date, round_even(value, 4) FROM holdings WHERE value <> 0),
{RET_SQL.split(EQUITY_ORD + ",", 1)[1]}, {DD_SQL},
{SUMMARY_AGG}
SELECT a.series, annual_return, volatility, sharpe, round_even(t.t.dd, 4) AS max_dd,
       CAST(greatest(t.t.day - t.t.peak_day, 0) AS BIGINT) AS max_dd_duration,
       total_return, n_points
FROM agg a JOIN trough t ON a.series = t.series""", dates=())
def sta14_all(spark, sf_dir):
    """The ledger's account curve and every symbol's curve through one summary."""
    bars, eod = _closes(spark, sf_dir), _eod(spark, sf_dir)
    hold = LG.holdings_grid(eod, bars)
    account = LG.account_equity(hold, LG.cash_by_date(eod, calendar=bars.select("date")))
    symbols = LG.symbol_equity_history(hold).withColumn("equity", round_even("value", 4))
    curves = ST.with_series_union(account.withColumn("equity", round_even("equity", 4)), symbols)
    return ST.summary(curves)


@register("sta15_stats_table", SUMMARY_SQL + """
SELECT a.series AS "Symbol", annual_return AS "Annual Return", volatility AS "Volatility",
       sharpe AS "Sharpe", round_even(t.t.dd, 4) AS "Max DD",
       CAST(greatest(t.t.day - t.t.peak_day, 0) AS BIGINT) AS "Max DD Duration"
FROM agg a JOIN trough t ON a.series = t.series""", dates=())
def sta15(spark, sf_dir):
    return ST.stats_table(ST.summary(_eq(spark, sf_dir)))


# ---- report datasets over bars / equity ---------------------------------------------

EV_TYPES = ["click", "error", "purchase", "signup", "view"]
_pp = ",\n       ".join(f"avg(CASE WHEN symbol = '{t}' THEN close END) AS {t}" for t in EV_TYPES)


@register("rpt1_price_pivot", f"""WITH {BARS_EV}
SELECT date, {_pp}
FROM bars_ev GROUP BY date""")
def rpt1(spark, sf_dir):
    return rounded(RP.price_pivot(FX.bars_ev(spark, sf_dir), EV_TYPES))


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ep = ",\n       ".join(f"max(CASE WHEN series = '{t}' THEN equity END) AS \"{t}\"" for t in PRIOS)


@register("rpt1b_equity_wide", f"""WITH {EQUITY_ORD}
SELECT date, {_ep}
FROM equity_ord WHERE series <> 'account' GROUP BY date""")
def rpt1b(spark, sf_dir):
    return rounded(RP.equity_wide(_eq(spark, sf_dir), PRIOS))


@register("rpt2_daily_and_cum_pnl", f"""WITH {EQUITY_ORD},
p AS (SELECT series, date, equity - lag(equity) OVER (PARTITION BY series ORDER BY date) AS pnl
      FROM equity_ord)
SELECT series, date, round_even(pnl, 4) AS pnl,
       round_even(sum(pnl) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cum_pnl
FROM p WHERE pnl IS NOT NULL""")
def rpt2(spark, sf_dir):
    return rounded(RP.daily_and_cum_pnl(_eq(spark, sf_dir)), {"pnl": 4, "cum_pnl": 4})


@register("rpt3_drawdown_pct", f"""WITH {EQUITY_ORD}
SELECT series, date, (equity / NULLIF(max(equity) OVER (PARTITION BY series ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1) * 100 AS drawdown_pct
FROM equity_ord""")
def rpt3(spark, sf_dir):
    return rounded(RP.drawdown_pct(_eq(spark, sf_dir)))


@register("rpt4_monthly_heatmap", f"WITH {MONTHLY_SQL} SELECT series, year, month, ret FROM lm",
          dates=())
def rpt4(spark, sf_dir):
    return ST.monthly_returns(_ret(spark, sf_dir))


PNL_SQL = f"""{EQUITY_ORD},
p AS (SELECT * FROM (SELECT series, date, equity - lag(equity) OVER (PARTITION BY series ORDER BY date) AS pnl
      FROM equity_ord) WHERE pnl IS NOT NULL),
rng AS (SELECT min(pnl) AS lo, max(pnl) AS hi FROM p)"""


@register("rpt6_pnl_histogram", f"""WITH {PNL_SQL}
SELECT series, least(CAST(floor(50 * (pnl - lo) / (hi - lo)) AS BIGINT) + 1, 50) AS bucket,
       count(*) AS n
FROM p, rng GROUP BY 1, 2""", dates=())
def rpt6(spark, sf_dir):
    return RP.pnl_histogram(ST.daily_pnl(_eq(spark, sf_dir)))


@register("rpt6b_pnl_box", f"""WITH {PNL_SQL}
SELECT series, round_even(quantile_cont(pnl, 0.0), 4) AS p0, round_even(quantile_cont(pnl, 0.25), 4) AS p25,
       round_even(quantile_cont(pnl, 0.5), 4) AS p50, round_even(quantile_cont(pnl, 0.75), 4) AS p75,
       round_even(quantile_cont(pnl, 1.0), 4) AS p100
FROM p GROUP BY series""", dates=())
def rpt6b(spark, sf_dir):
    box = RP.pnl_box(ST.daily_pnl(_eq(spark, sf_dir)))
    return rounded(box, {c: 4 for c in ("p0", "p25", "p50", "p75", "p100")})


@register("rpt8_rolling_sharpe", f"""WITH {RET_SQL}
SELECT series, date, round_even(CASE WHEN count(ret) OVER w >= 30
       THEN avg(ret) OVER w / NULLIF(stddev_samp(ret) OVER w, 0) END, 8) AS rolling_sharpe
FROM ret WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rpt8(spark, sf_dir):
    out = ST.rolling_sharpe(_ret(spark, sf_dir)).select("series", "date", "rolling_sharpe")
    return rounded(out, {"rolling_sharpe": 8})
