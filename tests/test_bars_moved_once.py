"""The daily table: rows are moved before they are sorted, and tasks grow with the rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from quantflow import session
from quantflow.plans import q_tables
from quantflow.sources import fixtures as FX
from quantflow.sources import sinks as SK
from quantflow.sources import tables as TB


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    day = dt.datetime(1998, 12, 1)
    rows = [(d * 3 + s, d, s, n, float(1 + (d * s) % 7), 1000.0 + 37 * ((d * (s + 3)) % 11), "N", "O", day + dt.timedelta(days=d))
            for s in (1, 2, None) for d in range(0, 450, 3) for n in (1, 2) for s in ([s] if s else [3])]
    rows.append((1, 1, None, 1, None, None, "N", "O", None))
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
                                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{root}/lineitem.parquet")
    return root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_split_of_the_lines_is_sorted_before_they_move(spark, sf_dir):
    """F8: the plan from the scan up to the first exchange."""
    before = plan(FX.daily_li(spark, sf_dir)).split("Exchange")[-1]
    assert "FileScan" in before and "Sort" not in before and "Aggregate" not in before


def test_tasks_grow_with_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    wide = FX.daily_li(spark, sf_dir)
    lines = TB.read_table(spark, sf_dir, "lineitem").count()
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan(wide))) == {str(lines // 40)}
    monkeypatch.undo()
    rows = sorted(map(tuple, wide.collect()), key=str)
    assert rows == sorted(map(tuple, FX.daily_li(spark, sf_dir).collect()), key=str) and len(rows) == lines // 2 + 1


def test_a_symbol_table_leaves_the_daily_rows_in_place(spark, monkeypatch):
    """the rows of the range are not moved for the semi-join."""
    daily = spark.createDataFrame([("a", 20240102, 1.0), ("b", 20240102, 2.0), (None, 20240103, 3.0), ("a", 20240201, 4.0)],
                                  "ts_code string, trade_date int, close double")
    names = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "name string")
    for few in (10, 1):
        monkeypatch.setattr(TB, "FEW_SYMBOLS", few)
        for symbols in (names, ["a", "c"]):
            made = TB.range_symbol_scan(daily, 20240101, 20240131, symbols)
            assert [tuple(r) for r in made.collect()] == [("a", 20240102, 1.0)]
            assert ("BroadcastHashJoin" in made._jdf.queryExecution().sparkPlan().toString()) is (few == 10)


def test_an_upsert_moves_its_rows_twice(spark, tmp_path, monkeypatch):
    """once to their keys, once to their month."""
    rows = [(f"{s:07d}", 20240100 + d, float(s)) for s in range(30) for d in (1, 15)]
    path = f"{tmp_path}/daily"
    SK.with_month(spark.createDataFrame(rows, "ts_code string, trade_date int, close double")).write.partitionBy("trade_month").parquet(path)
    batch = spark.createDataFrame([("0000001", 20240101, 9.0, 1), ("0000001", 20240101, 8.0, 2), ("0000099", 20240301, 7.0, 1)],
                                  "ts_code string, trade_date int, close double, seq bigint")
    hints = []
    plain = type(batch).hint
    monkeypatch.setattr(type(batch), "hint", lambda df, name, *a: hints.append(name) or plain(df, name, *a))
    monkeypatch.setattr(session, "TASK_ROWS", 5)  # 62 rows: 12 tasks
    out = SK.keyed_upsert(spark, path, SK.with_month(batch))
    assert hints == ["rebalance"] and out.count() == 61
    assert [r["close"] for r in out.where("ts_code = '0000001'").orderBy("trade_date").collect()] == [8.0, 1.0]


def test_the_upsert_query_reads_the_stored_table(spark, sf_dir, monkeypatch):
    """the daily rows are derived once, not for each of its base and two batches."""
    calls = []
    monkeypatch.setattr(q_tables, "_daily", lambda *a: calls.append(a) or FX.daily_li(*a))
    q_tables._STORED.clear()
    made = q_tables.snk1(spark, sf_dir)
    want = {(r["ts_code"], r["trade_date"]): r["close"] for r in q_tables.as_double(FX.daily_li(spark, sf_dir)).collect()}
    got = {(r["ts_code"], r["trade_date"]): r["close"] for r in made.collect()}
    assert len(calls) <= 1 and "lineitem" not in plan(made)
    for key, close in want.items():
        if key[1] is not None:
            assert got[key] == close + (0 if key[1] < 19990101 else 2 if key[1] <= 19990630 else 1)
    assert made.where(F.col("trade_date").isNotNull()).count() == sum(k[1] is not None for k in want)
