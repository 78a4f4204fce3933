"""Slippage, limit eligibility, as-of pricing (goldens of the reference's execution tests)."""

import datetime as dt

from quantflow.operators import execution as EX
from tests.conftest import approx

OSCHEMA = ("symbol string, date date, order_type string, direction string, quantity double, "
           "limit_price double")
BSCHEMA = "symbol string, date date, close double"
D = dt.date(2024, 1, 10)


def _exec(spark, orders, bars):
    o = spark.createDataFrame(orders, OSCHEMA)
    b = spark.createDataFrame(bars, BSCHEMA)
    return EX.execute_orders(EX.asof_price(o, b))


def test_market_slippage(spark):
    r = _exec(spark, [("AAPL", D, "MKT", "BUY", 10.0, None), ("AAPL", D, "MKT", "SELL", 5.0, None)],
              [("AAPL", D, 150.0)]).orderBy("direction").collect()
    assert approx(r[0]["fill_price"], 150.075) and approx(r[1]["fill_price"], 149.925)


def test_limit_buy(spark):
    fill = _exec(spark, [("T", D, "LIMIT", "BUY", 10.0, 96.0)], [("T", D, 95.0)]).first()
    assert fill["fill_price"] == 96.0 and fill["reject_reason"] is None
    none = _exec(spark, [("T", D, "LIMIT", "BUY", 10.0, 96.0)], [("T", D, 105.0)]).first()
    assert none["fill_price"] is None and none["reject_reason"] == "limit_buy_above_limit"


def test_limit_sell_and_equality(spark):
    r = _exec(spark, [("T", D, "LIMIT", "SELL", 10.0, 100.0)], [("T", D, 100.0)]).first()
    assert r["fill_price"] == 100.0
    r = _exec(spark, [("T", D, "LIMIT", "SELL", 10.0, 100.0)], [("T", D, 99.0)]).first()
    assert r["fill_price"] is None


def test_unknown_type_and_no_price(spark):
    r = _exec(spark, [("T", D, "STOP", "BUY", 1.0, None), ("X", D, "MKT", "BUY", 1.0, None)],
              [("T", D, 10.0)]).orderBy("symbol").collect()
    assert r[0]["reject_reason"] == "unknown_order_type"
    assert r[1]["reject_reason"] == "no_price"


def test_asof_uses_latest_bar_at_or_before(spark):
    bars = [("T", D - dt.timedelta(days=3), 10.0), ("T", D, 11.0), ("T", D + dt.timedelta(days=2), 12.0)]
    orders = [("T", D - dt.timedelta(days=5), "MKT", "BUY", 1.0, None),
              ("T", D - dt.timedelta(days=1), "MKT", "BUY", 1.0, None),
              ("T", D, "MKT", "BUY", 1.0, None),
              ("T", D + dt.timedelta(days=1), "MKT", "BUY", 1.0, None)]
    p = EX.asof_price(spark.createDataFrame(orders, OSCHEMA), spark.createDataFrame(bars, BSCHEMA))
    got = [r["market_price"] for r in p.orderBy("date").collect()]
    assert got == [None, 10.0, 11.0, 11.0]
