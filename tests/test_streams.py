"""Streaming operators: out-of-order, late, revised and repeated rows over several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantflow.operators import features as FE
from quantflow.operators import ledger as LG
from quantflow.plans.q_streams import replay_as_files
from quantflow.sources import commits as CM
from quantflow.streaming import streams as ST

DAY0 = dt.date(2024, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


def stream_of(spark, rows, schema):
    """``rows`` of (batch number, ...) as a stream of one file per batch."""
    root = ST.stream_dir(spark, "test-src")
    df = spark.createDataFrame(rows, f"__period int, {schema}")
    replay_as_files(df, root, "__period")
    return (spark.readStream.schema(df.drop("__period").schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(root))


# ---- STR3 / STR5 ---------------------------------------------------------------------

def run_features(spark, rows, **options):
    out = ST.stream_dir(spark, "test-out")
    ST.run_foreach_batch(ST.streaming_features(stream_of(spark, rows, "symbol long, date date, close double"), **options),
                         ST.append_batches(out), ST.stream_dir(spark, "test-ck"), mode="update")
    return spark.read.schema(ST.FEATURE_OUT).option("recursiveFileLookup", "true").parquet(out)


def test_shuffled_bars_give_the_batch_features(spark):
    rng = random.Random(4)
    bars = [(s, day(k), 10 + rng.random()) for s in (1, 2) for k in range(40)]
    rows = [(min(3, max(0, (b[1] - DAY0).days // 10 + rng.choice([0, 0, 1]))), *b) for b in bars]
    rows += [(3, 1, day(31), 99.0)]   # a revision, in a later batch than some of its followers
    rows = [r for r in rows if r[1:3] != (1, day(31)) or r[3] == 99.0]
    rows = [(1, 1, day(12), 5.0)] + [r if r[1:3] != (1, day(12)) else (2, *r[1:]) for r in rows]
    final = {(s, d): c for s, d, c in bars} | {(1, day(31)): 99.0}
    want = FE.with_features(spark.createDataFrame([(*k, c) for k, c in final.items()], "symbol long, date date, close double"))
    names = ["MA5", "MA10", "Volatility20", "Return_1d"]
    key = lambda df: {(r["symbol"], r["date"]): [r["close"], *[r[c] for c in names]] for r in df.collect()}
    made = run_features(spark, rows)
    got, want = key(ST.latest_features(made)), key(want)
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert a == b or a == pytest.approx(b, rel=1e-12), (k, a, b)
    assert made.where("late").count() == 0
    assert made.where("symbol = 1").groupBy("date").count().where("count > 1").count() > 0  # corrections


def test_a_bar_before_the_horizon_is_refused(spark):
    rows = [(0, 1, day(k), float(k + 1)) for k in range(60)] + [(1, 1, day(2), 7.0), (1, 1, day(58), 7.0)]
    made = run_features(spark, rows, horizon=5)
    late = made.where("late").collect()
    assert [(r["date"], r["close"]) for r in late] == [(day(2), 7.0)]
    last = {r["date"]: r["close"] for r in ST.latest_features(made).collect()}
    assert len(last) == 60 and last[day(2)] == 3.0 and last[day(58)] == 7.0


# ---- STR6 ----------------------------------------------------------------------------

FILL = "symbol long, date date, direction string, quantity double, price double, n long"


def run_ledger(spark, rows, delay="5 days"):
    out = ST.stream_dir(spark, "test-out")
    stream = ST.streaming_ledger(stream_of(spark, rows, FILL), order_cols=("date", "n"), delay=delay)
    ST.run_to_table(stream, out, ST.stream_dir(spark, "test-ck"))
    return spark.read.parquet(out)


def clock(batch, k):
    return (batch, -1, day(k), ST.CLOCK, None, None, 0)


def test_out_of_order_fills_fold_as_the_batch(spark):
    rng = random.Random(8)
    fills = [(s, day(k), rng.choice(["BUY", "BUY", "SELL", "SHORT"]), float(rng.randint(1, 5)), float(rng.randint(5, 9)), k * 10 + n)
             for s in (1, 2, 3) for k in range(12) for n in range(2)]
    rows = [((f[1] - DAY0).days // 4 + rng.choice([0, 0, 0, 1]), *f) for f in fills] + [clock(9, 90)]
    rng.shuffle(rows)
    got = run_ledger(spark, rows)
    want = LG.ledger_trajectory(spark.createDataFrame(fills, FILL).withColumn("ord", F.struct("date", "n")))
    names = ["symbol", "seq", "date", "direction", "accepted", "realized_pnl", "cash_delta", "position_qty", "avg_price", "reject_reason"]
    rows_of = lambda df: sorted(map(str, map(tuple, df.select(*names).collect())))
    assert rows_of(got) == rows_of(want)


def test_late_and_repeated_fills(spark):
    rows = [(0, 1, day(0), "BUY", 10.0, 5.0, 1), (0, 1, day(3), "SELL", 4.0, 6.0, 2),
            (1, 1, day(1), "BUY", 2.0, 5.0, 1), (1, 1, day(1), "BUY", 2.0, 5.0, 1),   # out of order, and twice
            clock(2, 20), clock(3, 21),
            (4, 1, day(2), "SELL", 1.0, 6.0, 1), (4, 2, day(2), "BUY", 1.0, 6.0, 1),  # too late
            (4, 1, day(30), "BUY", 1.0, 6.0, 1), clock(5, 60)]
    made = run_ledger(spark, rows)
    held = [(r["seq"], r["date"], r["position_qty"]) for r in ST.trades(made).orderBy("seq").collect()]
    assert held == [(1, day(0), 10.0), (2, day(1), 12.0), (3, day(1), 14.0), (4, day(3), 10.0), (5, day(30), 11.0)]
    refused = {(r["symbol"], r["date"], r["reject_reason"], r["seq"]) for r in ST.rejects(made).collect()}
    assert refused == {(1, day(2), "late", None), (2, day(2), "late", None)}


def test_fills_wait_for_the_watermark(spark):
    made = run_ledger(spark, [(0, 1, day(0), "BUY", 10.0, 5.0, 1), (0, 1, day(9), "BUY", 1.0, 5.0, 2)])
    assert [r["date"] for r in made.collect()] == [day(0)]  # day 9 may still get earlier fills


# ---- STR7 ----------------------------------------------------------------------------

def test_readers_see_whole_versions_only(spark):
    root = ST.stream_dir(spark, "test-table")
    assert CM.read_published(spark, root) is None
    CM.publish(spark, root, spark.range(3), 1)
    reader = CM.read_published(spark, root)

    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        CM.publish(spark, root, broken, 2)                       # dies before the pointer moves
    assert CM.current_version(spark, root) == 1 and CM.read_published(spark, root).count() == 3
    CM.publish(spark, root, spark.range(5), 2)
    assert CM.read_published(spark, root).count() == 5
    assert reader.count() == 3                                   # an open reader keeps its version


def test_portfolio_batches_in_any_order_and_twice(spark):
    rows = [(1, day(k), k + 1, 10.0 + k, -1.25, 5.0 + k) for k in range(6)] + [(1, day(9), None, None, None, 50.0),
            (2, day(1), None, None, None, 3.0), (3, day(2), 1, 4.0, -2.0, None)]
    marked = spark.createDataFrame(rows, "symbol long, date date, seq long, position_qty double, cash_delta double, close double")
    root = ST.stream_dir(spark, "test-table")
    fold = ST.portfolio_publisher(root)
    parts = [marked.where(F.pmod(F.xxhash64("symbol", "date"), F.lit(3)) == k) for k in (2, 0, 1)]
    for k, part in enumerate(parts):
        fold(part, k)
        fold(part, k)                                            # the batch runs again
    got = {r["symbol"]: r.asDict() for r in ST.portfolio_view(CM.read_published(spark, root), 100.0).collect()}
    assert got.keys() == {1, 3}
    assert (got[1]["quantity"], got[1]["price"], got[1]["value"]) == (15.0, 50.0, 750.0)
    assert (got[3]["quantity"], got[3]["price"], got[3]["value"]) == (4.0, None, 0.0)
    assert got[1]["cash"] == got[3]["cash"] == 100 - 6 * 1.25 - 2 and got[1]["equity"] == got[1]["cash"] + 750


# ---- STR2 ----------------------------------------------------------------------------

def test_daily_bars_follow_wall_clock_in_any_session_zone(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 23, 30), 1.0), ("a", dt.datetime(2024, 1, 2, 0, 10), 2.0),
            ("a", dt.datetime(2024, 1, 2, 9, 0), 3.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, value double")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {str(r["date"]): (r["open"], r["close"], r["volume"])
               for r in ST.tick_to_daily_bar(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {"2024-01-01": (1.0, 1.0, 1), "2024-01-02": (2.0, 3.0, 2)}


# ---- replay and buckets --------------------------------------------------------------

def test_a_period_of_many_files_is_one_batch(spark):
    rows = [(k, k * 1000 + i) for k, n in ((0, 4000), (1, 40), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "__period int, n long").repartition(8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "2k")
    try:
        root = ST.stream_dir(spark, "test-src")
        files = replay_as_files(df, root, "__period")
    finally:
        spark.conf.set(size, before)
    assert files > 1
    out = ST.stream_dir(spark, "test-out")
    src = (spark.readStream.schema("n long").option("maxFilesPerTrigger", files)
           .option("recursiveFileLookup", "true").parquet(root))
    ST.run_foreach_batch(src, ST.append_batches(out), ST.stream_dir(spark, "test-ck"))
    got = spark.read.parquet(out).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.expr("n div 1000")).alias("p")).collect()
    assert sorted(r["n"] for r in got) == [1, 40, 4000]


def test_symbols_of_one_bucket_keep_their_own_positions(spark):
    rows = [(0, s, day(d), "BUY", 2.0, 5.0, d) for s in (1, 2, None) for d in (1, 0)] + [(1, 2, day(30), "SELL", 1.0, 6.0, 1), clock(2, 60)]
    out = ST.stream_dir(spark, "test-out")
    stream = ST.streaming_ledger(stream_of(spark, rows, FILL), order_cols=("date", "n"), delay="5 days", buckets=1)
    ST.run_to_table(stream, out, ST.stream_dir(spark, "test-ck"))
    got = {(r["symbol"], r["seq"], r["date"], r["position_qty"]) for r in spark.read.parquet(out).collect()}
    assert got == {(s, k + 1, day(k), 2.0 * (k + 1)) for s in (1, 2, None) for k in (0, 1)} | {(2, 3, day(30), 3.0)}
