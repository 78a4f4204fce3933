"""Gates and order forming as table operators, and the commit of several tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantflow.operators import risk as RK
from quantflow.session import checkpoint_dir
from quantflow.sources import commits as CM
from quantflow.sources import sinks as SK


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_as_of_excludes_the_same_date_unless_asked(spark):
    left = spark.createDataFrame([("a", day(k), "own") for k in (0, 2, 3)] + [(None, day(5), "own")], "k string, date date, state string")
    right = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), None), ("b", day(1), 9.0), (None, day(4), 7.0)], "k string, date date, v double")
    got = {(r["k"], r["date"]): (r["state"], r["v"]) for r in RK.as_of(left, right, ["k"], ["v"]).collect()}
    assert got == {("a", day(0)): ("own", None), ("a", day(2)): ("own", 1.0), ("a", day(3)): ("own", None), (None, day(5)): ("own", 7.0)}
    same = {r["date"]: r["v"] for r in RK.as_of(left, right, ["k"], ["v"], same_date=True).where("k = 'a'").collect()}
    assert same == {day(0): 1.0, day(2): None, day(3): None}


@pytest.fixture(scope="module")
def decided(spark):
    """One account with two symbols and one that never traded."""
    prices = spark.createDataFrame([("x", day(0), 10.0), ("x", day(1), 10.0), ("x", day(2), 9.0), ("x", day(3), 9.0),
                                    ("y", day(0), 50.0), ("y", day(3), 1.0)], "symbol string, date date, close double")
    positions = spark.createDataFrame([("A", "x", day(0), 10.0, 10.0), ("A", "y", day(1), 20.0, 50.0), ("A", "x", day(3), 0.0, 0.0)],
                                      "account_id string, symbol string, date date, position_qty double, avg_price double")
    cash = spark.createDataFrame([("A", day(0), 900.0), ("A", day(1), 80.0)], "account_id string, date date, cash double")
    signals = [("A", "x", day(0), "BUY", 10.0), ("A", "x", day(1), "BUY", 10.0), ("A", "x", day(2), "SELL", 9.0),
               ("A", "y", day(2), "BUY", 50.0), ("A", "y", day(3), "SELL", 1.0), ("A", "x", day(1), None, 10.0),
               ("A", "y", day(1), "SELL", 50.0), ("A", "x", day(5), "HOLDING", 9.0), ("B", "x", day(2), "BUY", 9.0)]
    signals = spark.createDataFrame(signals, "account_id string, symbol string, date date, signal string, close double")
    state = RK.state_before(signals, positions, cash, prices, initial_cash=1000.0)
    return RK.decide(state, initial_cash=1000.0)


def test_signals_see_the_state_before_their_date(decided):
    rows = {(r["account_id"], r["symbol"], r["date"], r["signal"]): r for r in decided.collect()}
    see = lambda *k: tuple(rows[k][c] for c in ("cash_before", "held_qty", "equity_before"))
    assert see("A", "x", day(0), "BUY") == (1000.0, None, 1000.0)
    assert see("A", "x", day(1), "BUY") == (900.0, 10.0, 900.0 + 100)          # y's fill of the day is not seen
    assert see("A", "y", day(2), "BUY") == (80.0, 20.0, 80 + 10 * 9 + 20 * 50.0)  # y at its last price
    assert see("A", "y", day(3), "SELL") == (80.0, 20.0, 80 + 90 + 20.0)
    assert see("B", "x", day(2), "BUY") == (1000.0, None, 1000.0)
    # a position that was closed no longer counts, and the frozen peak blocks by the total
    assert see("A", "x", day(5), "HOLDING") == (80.0, 0.0, 80 + 20.0)


def test_gates_and_orders(decided):
    rows = {(r["account_id"], r["symbol"], r["date"], r["signal"]): (r["dd_blocked"], r["stop_blocked"], r["order_reject"], r["action"])
            for r in decided.collect()}
    assert rows["A", "x", day(1), "BUY"] == (False, False, None, "BUY")
    assert rows["A", "x", day(2), "SELL"] == (False, True, "risk_blocked", None)   # 10 % below cost
    assert rows["A", "y", day(2), "BUY"] == (False, False, "insufficient_cash", None)
    assert rows["A", "y", day(1), "SELL"] == (False, False, "insufficient_holdings", None)
    assert rows["A", "y", day(3), "SELL"][0] is True
    assert rows["A", "x", day(1), None] == (None, None, None, None)
    orders = {(r["account_id"], r["symbol"], r["direction"], r["quantity"]) for r in RK.form_orders(decided).collect()}
    assert orders == {("A", "x", "BUY", 10.0), ("B", "x", "BUY", 10.0)}


def test_gate_plan_holds_no_python(decided):
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ---- several tables, one commit ------------------------------------------------------

def rows_of(spark, root, table):
    return sorted(map(tuple, CM.read_committed(spark, root, table).collect()), key=str)


def test_tables_switch_together(spark):
    root = SK.staging_path(spark, "test-commit")
    a = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq long")
    b = lambda *r: spark.createDataFrame(list(r), "x int, y int, name string, seq long")
    keys = {"a": ["k"], "b": ["x", "y"]}
    refresh = lambda load: SK.refresh_tables(spark, root, load.__getitem__, keys)
    assert CM.read_committed(spark, root, "a") is None
    refresh({"a": a(("p", 1, 1), ("q", 2, 1), (None, 3, 1)), "b": b((1, 1, "one", 1), (1, 2, "two", 1))})
    refresh({"a": a(("q", 5, 1), ("q", 6, 2), (None, 4, 1), ("r", 7, 1)), "b": b((1, 2, "TWO", 1))})
    now = {"a": [("p", 1), ("q", 6), ("r", 7), (None, 4)], "b": [(1, 1, "one"), (1, 2, "TWO")]}
    assert {t: rows_of(spark, root, t) for t in keys} == {t: sorted(r, key=str) for t, r in now.items()}

    open_reader = CM.read_committed(spark, root, "a")
    lost = b((1, 1, "x", 1)).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        refresh({"a": a(("p", 99, 1)), "b": lost})       # a is written, b is not: nothing changes
    assert {t: rows_of(spark, root, t) for t in keys} == {t: sorted(r, key=str) for t, r in now.items()}
    refresh({"a": a(("p", 100, 1)), "b": b((2, 2, "new", 1))})
    assert ("p", 100) in rows_of(spark, root, "a") and (2, 2, "new") in rows_of(spark, root, "b")
    assert open_reader.count() == 4
    with pytest.raises(ValueError, match="stored by"):
        CM.upsert_tables(spark, root, {"a": (a(("p", 1, 1)), ["v"])})


def test_only_touched_buckets_are_written(spark):
    root = SK.staging_path(spark, "test-buckets")
    df = spark.range(200).selectExpr("cast(id as string) k", "id v", "1L seq")
    CM.upsert_tables(spark, root, {"t": (df, ["k"])})
    before = CM.manifest(spark, root)["tables"]["t"]["buckets"]
    CM.upsert_tables(spark, root, {"t": (df.limit(1), ["k"])})
    after = CM.manifest(spark, root)["tables"]["t"]["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and CM.read_committed(spark, root, "t").count() == 200


def test_claims_are_exclusive(spark):
    path = f"{checkpoint_dir(spark)}/claim-{dt.datetime.now().timestamp()}"
    assert CM.put_if_absent(spark, path, "1") and not CM.put_if_absent(spark, path, "2")
    assert CM.read_text(spark, path) == "1"
    CM.replace_text(spark, path, "3")
    assert CM.read_text(spark, path) == "3"


def test_a_pointer_is_never_missing_while_it_is_replaced(spark):
    from concurrent.futures import ThreadPoolExecutor
    path = f"{checkpoint_dir(spark)}/pointer-{dt.datetime.now().timestamp()}/CURRENT"
    CM.replace_text(spark, path, "0")
    with ThreadPoolExecutor(3) as pool:
        writers = [pool.submit(lambda: [CM.replace_text(spark, path, "1" * 50) for _ in range(40)]) for _ in range(2)]
        seen = pool.submit(lambda: {CM.read_text(spark, path) for _ in range(80)})
        assert seen.result() <= {"0", "1" * 50} and all(w.result() for w in writers)
