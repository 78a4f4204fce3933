"""BKT1 on arrays: the days of an account are those of its decisions, bit for bit."""

import datetime as dt
import glob
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantflow import params as P
from quantflow.operators import backtest as BT
from quantflow.session import checkpoint_dir

GRID = [P.BacktestParams(window=3, stop_loss=0.02, max_drawdown=0.5),
        P.BacktestParams(window=2, order_size=40, initial_cash=3000.0, max_drawdown=0.9, running_peak=True, block_sells_on_stop=False)]


def bars_and_members(spark, name=int, seed=3):
    rng = random.Random(seed)
    rows = []
    for s in range(12):
        price = 20.0 + s
        for k in range(50):
            price = round(max(1.0, price * (1 + rng.uniform(-0.06, 0.06))), 2)
            if rng.random() < 0.8:
                close = None if rng.random() < 0.01 else 20.0 if rng.random() < 0.1 else price
                rows.append((name(s), dt.date(2024, 1, 1) + dt.timedelta(days=k), close))
    kind = "long" if name is int else "string"
    bars = spark.createDataFrame(rows, f"symbol {kind}, date date, close double").coalesce(1)
    members = [(f"acct{a}", a % 2, name(s)) for a in range(3) for s in range(12) if a < 2 or s < 4]
    return bars, spark.createDataFrame(members, f"account_id string, param_id long, symbol {kind}")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select("account_id", "param_id", "date", "replay", "cash", "equity").collect())))


@pytest.mark.parametrize("block_rows", [None, 100])
@pytest.mark.parametrize("name", [int, "s{}".format])
def test_days_are_the_snapshots_of_the_decisions(spark, name, block_rows):
    bars, members = bars_and_members(spark, name)
    prm = BT.params_frame(spark, GRID)
    decisions = BT.backtest(bars, members, prm).localCheckpoint()
    assert decisions.where("action = 'SELL'").count() > 5 and decisions.where("stop_blocked").count() > 0
    days = BT.backtest(bars, members, prm, output="days", block_rows=block_rows)
    assert days.count() == decisions.select("account_id", "date", "replay").distinct().count()
    assert rows_of(BT.snapshots(days)) == rows_of(BT.snapshots(decisions))


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("name", [int, "s{:02d}".format])
def test_two_bars_of_a_symbol_on_a_date_and_runs_over_batches(name, size):
    """The folds themselves on the same rows: Spark leaves the order of equal keys open."""
    rng = random.Random(5)
    rows = [(f"a{a}", a, name(s), d, 0, rng.choice([float("nan"), 25.0, *[rng.uniform(15, 30) for _ in range(20)]]),
             rng.choice([None, "BUY", "SELL", "SELL", "HOLDING"]))
            for a in (0, 1) for d in range(60) for s in range(10) for _ in range(rng.choice([0, 1, 1, 2]))]
    pdf = pd.DataFrame(rows, columns=[*BT.IN_COLS, "signal"])
    coded = pdf.assign(signal=pdf["signal"].map(lambda x: BT.SIGNALS.index(x) if isinstance(x, str) else 0).astype("int8"))
    grid = {k: g.__dict__ for k, g in enumerate(GRID)}
    chunks = lambda frame: (frame.iloc[k:k + size] for k in range(0, len(frame), size))
    decisions = pd.concat(BT._fold(grid)(chunks(pdf)))
    days = pd.concat(BT._fold_days(grid)(chunks(coded)))
    keys = ["account_id", "param_id", "date", "replay"]
    want = decisions.groupby(keys, as_index=False).first()
    assert len(days) == len(want) and (decisions["action"] == "SELL").any()
    for c in (*keys, "equity_before", "cash", "equity"):
        assert list(map(repr, days[c].tolist())) == list(map(repr, want[c].tolist())), c


def test_blocks_hold_days_not_decisions(spark):
    bars, members = bars_and_members(spark)
    days = BT.backtest(bars, members, BT.params_frame(spark, GRID), output="days", block_rows=100)
    folder = max(glob.glob(f"{checkpoint_dir(spark).replace('file:', '')}/backtest-*"), key=lambda f: len(glob.glob(f"{f}/block-*")))
    written = spark.read.parquet(*glob.glob(f"{folder}/block-*"))
    assert set(written.columns) == {*BT.DAY_COLS, "state"} and days.count() <= 3 * 50


def test_days_replay_a_date_per_row_too(spark):
    bars, members = bars_and_members(spark)
    bars, prm = bars.where(F.col("date") < "2024-01-12").localCheckpoint(), BT.params_frame(spark, GRID)
    made = [BT.snapshots(BT.backtest(bars, members, prm, replay="per_row", output=o)) for o in ("days", "decisions")]
    assert rows_of(made[0]) == rows_of(made[1])
