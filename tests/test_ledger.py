"""Fees, cash, positions and realized PnL (goldens of the reference's portfolio tests)."""

import datetime as dt

from pyspark.sql import functions as F

from quantflow.operators import ledger as LG
from tests.conftest import approx

SCHEMA = "symbol string, date date, seq long, direction string, quantity double, price double"
D0 = dt.date(2024, 1, 1)


def _traj(spark, rows):
    fills = spark.createDataFrame([(s, D0 + dt.timedelta(days=i), i, d, float(q), float(p))
                                   for i, (s, d, q, p) in enumerate(rows)], SCHEMA)
    return LG.ledger_trajectory(fills, order=("seq",))


def _cash(spark, rows):
    return LG.cash_by_date(_traj(spark, rows)).orderBy("date").collect()[-1]["cash"]


def test_buy_fee_minimum(spark):
    t = _traj(spark, [("AAPL", "BUY", 10, 100.0)]).first()
    assert t["commission"] == 5.0
    assert approx(_cash(spark, [("AAPL", "BUY", 10, 100.0)]), 98995.0)


def test_small_buy(spark):
    assert approx(_cash(spark, [("AAPL", "BUY", 1, 1.0)]), 99994.0)


def test_round_trip_realized(spark):
    rows = [("AAPL", "BUY", 100, 10.0), ("AAPL", "SELL", 100, 12.0)]
    last = _traj(spark, rows).orderBy("seq").collect()[-1]
    assert approx(last["realized_pnl"], 188.788)
    assert last["position_qty"] == 0 and last["avg_price"] == 0.0
    assert approx(_cash(spark, rows), 100188.788)


def test_partial_sell(spark):
    rows = [("AAPL", "BUY", 100, 10.0), ("AAPL", "SELL", 50, 12.0)]
    last = _traj(spark, rows).orderBy("seq").collect()[-1]
    assert approx(last["trade_pnl"], 91.894)
    assert last["position_qty"] == 50


def test_average_cost_sequence(spark):
    rows = [("AAPL", "BUY", 100, 10.0), ("AAPL", "SELL", 50, 12.0),
            ("AAPL", "BUY", 50, 14.0), ("AAPL", "SELL", 100, 15.0)]
    t = _traj(spark, rows).orderBy("seq").collect()
    assert approx(t[2]["avg_price"], 12.0)
    assert approx(t[-1]["realized_pnl"], 377.879, 1e-6)


def test_symbols_independent(spark):
    rows = [("AAPL", "BUY", 10, 100.0), ("MSFT", "BUY", 10, 200.0), ("AAPL", "SELL", 10, 110.0)]
    fp = {r["symbol"]: r for r in LG.final_positions(_traj(spark, rows)).collect()}
    assert fp["MSFT"]["position_qty"] == 10 and fp["MSFT"]["realized_pnl"] == 0.0
    assert fp["AAPL"]["position_qty"] == 0 and fp["AAPL"]["realized_pnl"] > 0


def test_sell_without_holdings_rejected(spark):
    t = _traj(spark, [("AAPL", "SELL", 10, 100.0)]).first()
    assert t["accepted"] is False and t["reject_reason"] == "sell_without_holdings"
    assert approx(_cash(spark, [("AAPL", "SELL", 10, 100.0)]), 100000.0)


def test_hot_key_spans_batches(spark):
    """One key far larger than an Arrow batch: the sorted scan carries state across batches
    and matches a plain sequential fold."""
    n = 25_000
    rows = [("HOT", "BUY" if i % 3 else "SELL", float(1 + i % 7), 10.0 + (i % 11)) for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        t = _traj(spark, rows).orderBy("seq").select("realized_pnl", "position_qty").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pos = LG.new_position()
    for _, d, q, p in rows:
        LG.apply_fill(pos, d, q, p)
    assert len(t) == n
    assert t[-1]["realized_pnl"] == pos[4] and t[-1]["position_qty"] == pos[0]


def test_fee_expressions(spark):
    df = spark.createDataFrame([("BUY", 10.0, 100.0), ("SELL", 10.0, 1000.0)],
                               "direction string, quantity double, price double")
    r = LG.fee_columns(df).orderBy("direction").collect()
    assert r[0]["fee"] == 5.0
    assert approx(r[1]["fee"], 10.0 + 10.0 + 0.1)


def test_money_sums_are_exact(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "v double")
    s = df.agg(F.sum(LG.money("v")).cast("double").alias("s")).first()["s"]
    assert s == 0.6


def test_two_accounts_same_symbol_valuation(spark):
    """Ledger keyed by (account, symbol): valuation and equity per account."""
    fills = spark.createDataFrame(
        [("x", "AAPL", D0, 1, "BUY", 10.0, 100.0), ("y", "AAPL", D0, 1, "BUY", 20.0, 100.0),
         ("y", "AAPL", D0 + dt.timedelta(days=1), 2, "SELL", 5.0, 110.0)],
        "account_id string, symbol string, date date, seq long, direction string, "
        "quantity double, price double")
    bars = spark.createDataFrame([("AAPL", D0, 100.0), ("AAPL", D0 + dt.timedelta(days=1), 110.0),
                                  ("AAPL", D0 + dt.timedelta(days=2), 120.0)],
                                 "symbol string, date date, close double")
    traj = LG.ledger_trajectory(fills, keys=("account_id", "symbol"), order=("seq",))
    eod = LG.positions_eod(traj, keys=("account_id", "symbol"))
    cal = bars.select("date")
    cal_acc = cal.crossJoin(fills.select("account_id").distinct())
    grid = LG.holdings_grid(eod, bars, keys=("account_id", "symbol"))
    hv = LG.holdings_value_by_date(eod, bars, cal_acc, keys=("account_id", "symbol"),
                                   account_keys=("account_id",))
    cash = LG.cash_by_date(eod, account_keys=("account_id",), calendar=cal_acc)
    eq = {(r["account_id"], str(r["date"])): r["equity"]
          for r in LG.account_equity(hv, cash, ("account_id",)).collect()}
    eq_grid = {(r["account_id"], str(r["date"])): r["equity"]
               for r in LG.account_equity(grid, cash, ("account_id",)).collect()}
    assert eq == eq_grid
    last = str(D0 + dt.timedelta(days=2))
    assert approx(eq[("x", last)], 100000 - 1005 + 10 * 120)
    assert approx(eq[("y", last)], 100000 - 2005 + (550 - 5 - 0.55 - 0.0055) + 15 * 120)


def test_states_from_the_scan_equal_those_of_the_trajectory(spark):
    import random
    rng = random.Random(2)
    rows = [(rng.choice("ABC"), dt.date(2024, 1, 1 + k // 9), k, rng.choice(["BUY", "SELL", "SELL", "HOLDING"]),
             float(rng.randint(1, 4)), rng.random() * 50) for k in range(200)]
    fills = spark.createDataFrame(rows, "symbol string, date date, seq long, direction string, quantity double, price double")
    traj = LG.ledger_trajectory(fills, order=("seq",))
    same = lambda a, b: sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.select(*a.columns).collect())))
    assert same(LG.final_positions(traj), LG.ledger_states(fills, order=("seq",)))
    assert same(LG.positions_eod(traj, materialize=False), LG.ledger_states(fills, order=("seq",), date="date"))
    assert LG.ledger_states(fills.limit(0), order=("seq",)).count() == 0


def _round_trips(n, seed, oversell):
    """Fills of one key that is flat now and then, with dropped SELLs at flat points."""
    import random
    rng, pool, rows = random.Random(seed), 0, []
    for k in range(n):
        direction = rng.choice(["BUY", "SELL", "SELL", "HOLDING"])
        size = rng.randint(1, 4)
        if k in (oversell - 1, oversell):
            direction = "BUY" if k < oversell else "SELL"
        if direction == "SELL" and pool > 0:
            size = rng.choice([pool, rng.randint(1, pool)])
        if direction == "SELL" and k == oversell:
            size = pool + 3
        if direction == "BUY":
            pool += size
        elif direction == "SELL" and pool > 0:
            pool = max(0, pool - size)
        rows.append(("hot", dt.date(2020, 1, 1) + dt.timedelta(days=k // 5), k, direction, float(size), rng.random() * 50))
    return rows


def test_hot_key_in_pieces_gives_the_same_rows(spark):
    names = "symbol string, date date, seq long, direction string, quantity double, price double"
    rows = _round_trips(4000, 1, -1) + [("over", *r[1:]) for r in _round_trips(400, 2, 150)]
    rows += [("parts", r[1], r[2], r[3], r[4] + 0.1, r[5]) for r in _round_trips(100, 3, -1)]
    fills = spark.createDataFrame(rows, names).withColumnRenamed("seq", "n")
    one = LG.ledger_trajectory(fills, order=("n",))
    many = LG.ledger_trajectory(fills, order=("n",), split_rows=50)
    key = lambda df: sorted(map(str, map(tuple, df.select(*one.columns).collect())))
    assert key(one) == key(many)
    blocks = {r["symbol"]: r["count"] for r in LG.flat_blocks(fills, ["symbol"], ["n"], 50)
              .select("symbol", "__block").distinct().groupBy("symbol").count().collect()}
    assert blocks["hot"] > 40 and blocks["over"] < 8 and blocks["parts"] == 1


def test_a_large_hot_key_is_folded_by_many_tasks(spark):
    """One key of 200,000 fills: no task folds more than a tenth of them."""
    from pyspark.sql import functions as F
    k = F.col("id") % 4
    fills = spark.range(200_000).select(
        F.lit("hot").alias("symbol"), F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id").alias("n"),
        F.when(k < 2, "BUY").otherwise("SELL").alias("direction"), F.lit(2.0).alias("quantity"), (10 + F.col("id") % 7).cast("double").alias("price"))
    many = LG.ledger_trajectory(fills, order=("n",), split_rows=1000, num_partitions=64)
    assert many.where("accepted").count() == 200_000
    blocks = LG.flat_blocks(fills, ["symbol"], ["n"], 1000).repartition(64, "symbol", "__block")
    sizes = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 20_000 and len(sizes) > 30
    last = many.agg(F.max_by("realized_pnl", "seq")).first()[0]
    assert last == LG.ledger_states(fills, order=("n",)).first()["realized_pnl"]
