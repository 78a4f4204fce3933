"""Stored daily table: scans and upserts touch only the months they need."""

import contextlib
import glob
import io
import os

import pytest
from pyspark.sql import functions as F

from quantflow.sources import sinks as SK
from quantflow.sources import tables as TB


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(f"{s:07d}", 20240000 + m * 100 + d, float(s)) for s in range(3) for m in range(1, 7) for d in (1, 15)]
    path = f"{tmp_path}/daily"
    SK.with_month(spark.createDataFrame(rows, "ts_code string, trade_date int, close double")) \
        .write.partitionBy("trade_month").parquet(path)
    return path


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_range_and_day_scans_prune_months(spark, table):
    df = spark.read.parquet(table)
    scan = TB.range_symbol_scan(df, 20240201, 20240331, ["0000001"])
    assert "trade_month" in plan(scan).split("PartitionFilters:")[1].split("\n")[0] and scan.count() == 4
    day = TB.one_day_scan(df, 20240415)
    assert "trade_month" in plan(day).split("PartitionFilters:")[1].split("\n")[0] and day.count() == 3
    assert TB.latest_universe(df).count() == 3
    with pytest.raises(ValueError):
        TB.one_day_scan(df, 20241340)


def test_upsert_leaves_other_months_alone(spark, table):
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{table}/*/*.parquet")}
    batch = SK.with_month(spark.createDataFrame([("0000001", 20240301, 9.0, 1), ("0000001", 20240301, 8.0, 2), ("0000009", 20240302, 7.0, 1)],
                                                "ts_code string, trade_date int, close double, seq bigint"))
    out = SK.keyed_upsert(spark, table, batch)
    assert out.count() == 37
    assert out.where(F.col("trade_date") == 20240301).where("ts_code = '0000001'").first()["close"] == 8.0
    after = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{table}/*/*.parquet")}
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if "trade_month=202403" in p}
    with pytest.raises(ValueError):
        SK.keyed_upsert(spark, table, batch.drop("close"))


def _row_groups(path, column):
    """(row groups, those whose range holds each value) of all files below a local folder."""
    import glob

    import pyarrow.parquet as pq
    spans = []
    for f in glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        spans += [(s.min, s.max) for s in (meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups))]
    return spans


def test_a_symbol_slice_needs_few_row_groups(spark):
    from quantflow.sources import sinks as SK
    from quantflow.sources import tables as TB
    path = SK.staging_path(spark, "test-clustered")
    df = spark.range(300_000).selectExpr("format_string('%07d', (id * 7919) % 500) ts_code", "cast(20240100 + id % 28 as int) trade_date",
                                         "202401 trade_month", "rand(3) close")
    SK.write_clustered(df, path, "trade_month", ("ts_code", "trade_date"), row_group_bytes=64 << 10)
    spans = _row_groups(path, "ts_code")
    hit = [s for s in spans if s[0] <= "0000123" <= s[1]]
    assert len(spans) >= 20 and len(hit) <= len(spans) / 5
    cut = TB.symbol_slice(spark.read.parquet(path), "0000123", "ts_code")
    assert cut.count() == 600
    assert "EqualTo(ts_code,0000123)" in cut._jdf.queryExecution().executedPlan().toString()


def test_feature_store_appends_are_idempotent(spark):
    import datetime as dt

    from quantflow.operators import features as FE
    from quantflow.sources import sinks as SK
    path = SK.staging_path(spark, "test-features")
    day = lambda k: dt.date(2024, 1, 20) + dt.timedelta(days=k)
    made = lambda ks, v: spark.createDataFrame([(s, day(k), v) for s in "ab" for k in ks], "symbol string, date date, MA5 double")
    FE.write_feature_store(made(range(20), 1.0), path)
    for _ in range(2):
        FE.write_feature_store(made(range(15, 25), 2.0), path)
    rows = {(r["symbol"], r["date"]): r["MA5"] for r in FE.read_feature_store(spark, path).collect()}
    assert rows == {(s, day(k)): 1.0 if k < 15 else 2.0 for s in "ab" for k in range(25)}
    assert FE.read_feature_store(spark, path, ["a"], day(3), day(17)).count() == 15
    FE.write_feature_store(made([0], 9.0), path, mode="overwrite")      # January only
    assert FE.read_feature_store(spark, path).count() == 2 + 2 * 13
