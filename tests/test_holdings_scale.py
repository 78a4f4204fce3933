"""Keys x dates rows stay where they are made; wide rows are built once a date."""

import datetime as dt
import re

from pyspark.sql import functions as F

from quantflow.operators import ledger as LG


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def frames(spark):
    eod = spark.createDataFrame(
        [(1, day(0), 5.0), (1, day(4), 0.0), (2, day(3), 7.0), (None, day(2), 1.0), (None, day(2), 2.0), (3, None, 9.0)],
        "symbol long, date date, position_qty double")
    bars = spark.createDataFrame(
        [(1, day(0), 2.0), (1, day(2), 3.0), (1, day(3), None), (4, day(5), 8.0), (2, day(4), 4.0), (None, day(1), 6.0)],
        "symbol long, date date, close double")
    return eod, bars


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holdings_of_odd_keys_and_days(spark):
    got = sorted(map(tuple, LG.holdings_grid(*frames(spark)).collect()), key=str)
    want = [(1, day(k), 5.0 if k < 4 else 0.0, 2.0 if k < 2 else 3.0) for k in range(6)]
    want += [(2, day(3), 7.0, None), (2, day(4), 7.0, 4.0), (2, day(5), 7.0, 4.0)]
    want += [(None, day(k), None, None) for k in range(2, 6)]
    assert got == sorted([(*r, None if r[2] is None else r[2] * (r[3] or 0.0)) for r in want], key=str)


def test_prices_reach_every_account_of_a_symbol(spark):
    eod = spark.createDataFrame([("a", 1, day(1), 5.0), ("b", 1, day(2), 1.0)], "account string, symbol long, date date, position_qty double")
    got = LG.holdings_grid(eod, frames(spark)[1], keys=("account", "symbol"))
    want = {("a", k): 15.0 if k >= 2 else 10.0 for k in range(1, 6)} | {("b", k): 3.0 for k in range(2, 6)}
    assert {(r["account"], (r["date"] - day(0)).days): r["value"] for r in got.collect()} == want


def test_the_grid_is_not_moved(spark):
    above = plan(LG.holdings_grid(*frames(spark))).split("Generate explode")[0]
    assert "Exchange" not in above.replace("BroadcastExchange", "") and "SortMergeJoin" not in above


def test_wide_rows_are_built_in_one_task_a_date(spark, monkeypatch):
    rows = [(s, day(k), float(10 * s + k)) for s in range(1, 5) for k in range(3) if s + k != 4]
    history = spark.createDataFrame(rows, "symbol long, date date, value double")
    few = sorted(map(tuple, LG.symbol_equity_wide(history, [1, 2]).collect()))
    assert few == [(day(k), 10.0 + k, 20.0 + k if k != 2 else None) for k in range(3)]
    monkeypatch.setattr(LG, "FEW_SYMBOLS", 1)
    long_list = LG.symbol_equity_wide(history, [1, 2])
    assert sorted(map(tuple, long_list.collect())) == few
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan(long_list).split("Initial Plan")[-1])
    assert len(keys) == 1 and keys[0].startswith("date#") and "," not in keys[0]


def test_snapshot_rows_leave_the_holdings_in_place(spark):
    holdings = LG.holdings_grid(*frames(spark))
    cash = spark.createDataFrame([(day(k), 100.0) for k in range(-1, 6)], "date date, cash double")
    made = LG.snapshot_rows(holdings, cash)
    rows = {(r["date"], r["symbol"]): (r["equity"], r["value"]) for r in made.collect()}
    assert rows[(day(-1), None)] == (100.0, None) and rows[(day(2), 1)] == (115.0, 15.0) and rows[(day(2), None)] == (115.0, None)
    assert made.count() == holdings.count() + 1
    assert "LeftOuter" not in plan(made.where(F.col("symbol") > 0)).split("Generate explode")[0]


def test_snapshot_maps_are_in_the_order_of_symbols(spark):
    rows = [(s, day(0), 1.0) for s in (10, 9, 100, 2)]
    holdings = spark.createDataFrame(rows, "symbol long, date date, value double").repartition(4)
    cash = spark.createDataFrame([(day(0), 0.0)], "date date, cash double")
    # a collected map has no order
    assert LG.daily_snapshot(holdings, cash).select(F.map_keys("holdings")).first()[0] == ["2", "9", "10", "100"]
