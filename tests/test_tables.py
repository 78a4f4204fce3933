"""Scans, upsert and normalisation behaviour."""

import pytest
from pyspark.sql import functions as F

from quantflow.session import checkpoint_dir
from quantflow.sources import sinks as SK
from quantflow.sources import tables as TB

from decimal import Decimal

SCHEMA = "ts_code string, trade_date int, close decimal(18,4), seq long"


def _rows(rows):
    return [(a, b, Decimal(c), d) for a, b, c, d in rows]


def test_range_scan_start_after_end_raises(spark):
    df = spark.createDataFrame(_rows([("0000001", 20240101, 1, 1)]), SCHEMA)
    with pytest.raises(ValueError):
        TB.range_symbol_scan(df, 20240105, 20240101)


def test_range_scan_symbols_and_bounds(spark):
    df = spark.createDataFrame(_rows([("a", 20240101, 1, 1), ("b", 20240102, 1, 1), ("a", 20240110, 1, 1)]), SCHEMA)
    assert TB.range_symbol_scan(df, 20240101, 20240105, ["a"]).count() == 1
    assert TB.range_symbol_scan(df, 20240101, 20240105, []).count() == 2


def test_upsert_new_wins_and_is_idempotent(spark):
    import uuid
    path = f"{checkpoint_dir(spark)}/t-upsert-{uuid.uuid4().hex}"
    base = SK.with_month(spark.createDataFrame(
        _rows([("a", 20240101, 1, 0), ("a", 20240201, 2, 0)]), SCHEMA))
    SK.keyed_upsert(spark, path, base)
    batch = SK.with_month(spark.createDataFrame(
        _rows([("a", 20240101, 5, 1), ("a", 20240101, 7, 2), ("b", 20240101, 9, 1)]), SCHEMA))
    once = SK.keyed_upsert(spark, path, batch).orderBy("ts_code", "trade_date").collect()
    twice = SK.keyed_upsert(spark, path, batch).orderBy("ts_code", "trade_date").collect()
    assert [(r["ts_code"], r["trade_date"], int(r["close"])) for r in once] == \
        [("a", 20240101, 7), ("a", 20240201, 2), ("b", 20240101, 9)]
    assert once == twice


def test_normalise_and_date_parse(spark):
    df = spark.createDataFrame([("0000001", 20240131, 1.0)], "ts_code string, trade_date int, vol double")
    n = TB.normalise_bars(df).first()
    assert n["symbol"] == "0000001" and str(n["date"]) == "2024-01-31" and n["volume"] == 1.0
    with pytest.raises(ValueError):
        TB.normalise_bars(df, adjustment="qfq")


def test_column_mapping_missing_raises(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        TB.column_mapping(df, {"b": "c"})


def test_dirty_dates_become_null(spark):
    df = spark.createDataFrame([("20240230",), ("x",)], "trade_date string")
    assert TB.date_parse(df).where(F.col("date").isNull()).count() == 2


def test_one_day_scan_default_and_none(spark):
    df = spark.createDataFrame(_rows([("a", 20240101, 1, 1)]), SCHEMA)
    assert TB.one_day_scan(df, 20240101).count() == 1
    assert TB.one_day_scan(df, None).count() == 0
    assert TB.one_day_scan(df).count() == 0  # today: no row
