"""Registered queries: as-of pricing and order execution (JOIN1, EXE*, BKT4 on orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantflow.operators import execution as EX
from quantflow.plans.oracle_views import ctes
from quantflow.plans.registry import register
from quantflow.plans.util import rounded
from quantflow.sources import fixtures as FX

ASOF_SQL = ctes("bars_li", "orders_li") + """,
priced AS (
  SELECT o.*, b.close AS market_price, b.date AS bar_date
  FROM orders_li o ASOF LEFT JOIN bars_li b ON o.symbol = b.symbol AND o.date >= b.date)"""

OUT_COLS = ("symbol, date, l_orderkey, l_linenumber, order_type, direction, quantity, "
            "limit_price")

EXEC_SQL = ASOF_SQL + """,
ex AS (
  SELECT *,
    CASE WHEN market_price IS NULL THEN 'no_price'
         WHEN order_type NOT IN ('MKT', 'LIMIT') THEN 'unknown_order_type'
         WHEN order_type = 'LIMIT' AND direction = 'BUY' AND market_price > limit_price THEN 'limit_buy_above_limit'
         WHEN order_type = 'LIMIT' AND direction = 'SELL' AND market_price < limit_price THEN 'limit_sell_below_limit'
    END AS reject_reason
  FROM priced),
ex2 AS (
  SELECT *,
    CASE WHEN reject_reason IS NOT NULL THEN NULL
         WHEN order_type = 'MKT' THEN market_price * (1.0::DOUBLE + (CASE WHEN direction = 'BUY' THEN 1 WHEN direction = 'SELL' THEN -1 ELSE 0 END) * 0.0005::DOUBLE)
         ELSE limit_price END AS fill_price
  FROM ex)"""


def _orders(spark, sf_dir):
    o = FX.orders_li(spark, sf_dir)
    return o.select("*", F.col("ord.l_orderkey").alias("l_orderkey"),
                    F.col("ord.l_linenumber").alias("l_linenumber")).drop("ord")


def _executed(spark, sf_dir):
    priced = EX.asof_price(_orders(spark, sf_dir), FX.bars_li(spark, sf_dir))
    return EX.execute_orders(priced)


@register("join1_asof_price", f"""WITH {ASOF_SQL}
SELECT {OUT_COLS}, market_price, bar_date FROM priced""", dates=("date", "bar_date"),
          bench=True)
def join1(spark, sf_dir):
    p = EX.asof_price(_orders(spark, sf_dir), FX.bars_li(spark, sf_dir))
    return rounded(p.select(*[c.strip() for c in OUT_COLS.split(",")], "market_price",
                            "bar_date"))


@register("exe1_slippage", f"""WITH {EXEC_SQL}
SELECT {OUT_COLS}, market_price, fill_price FROM ex2 WHERE order_type = 'MKT'""")
def exe1(spark, sf_dir):
    e = _executed(spark, sf_dir).where(F.col("order_type") == "MKT")
    return rounded(e.select(*[c.strip() for c in OUT_COLS.split(",")], "market_price",
                            "fill_price"))


@register("exe2_limit_eligibility", f"""WITH {EXEC_SQL}
SELECT {OUT_COLS}, market_price, fill_price, reject_reason FROM ex2 WHERE order_type = 'LIMIT'""")
def exe2(spark, sf_dir):
    e = _executed(spark, sf_dir).where(F.col("order_type") == "LIMIT")
    return rounded(e.select(*[c.strip() for c in OUT_COLS.split(",")], "market_price",
                            "fill_price", "reject_reason"))


@register("exe3_order_to_fill", f"""WITH {EXEC_SQL}
SELECT {OUT_COLS}, fill_price, reject_reason FROM ex2""")
def exe3(spark, sf_dir):
    e = _executed(spark, sf_dir)
    return rounded(e.select(*[c.strip() for c in OUT_COLS.split(",")], "fill_price",
                            "reject_reason"))


@register("bkt4_rejects_report", f"""WITH {EXEC_SQL}
SELECT reject_reason, count(*) AS n FROM ex2 WHERE reject_reason IS NOT NULL GROUP BY 1""",
          dates=())
def bkt4(spark, sf_dir):
    _, rej = EX.fills_and_rejects(_executed(spark, sf_dir))
    return EX.rejects_report(rej)
