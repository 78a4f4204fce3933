"""LED13 for many symbols: no expression a column, the rows of the pivot."""

import datetime as dt
import random

import pytest

from quantflow.operators import ledger as LG


def history(spark, name, n=30):
    rng = random.Random(1)
    rows = [(name(s), dt.date(2024, 1, 1) + dt.timedelta(days=k), rng.choice([1.5, -2.0, float("nan"), None, rng.random()]))
            for s in range(n) for k in range(40) if rng.random() < 0.4]
    return spark.createDataFrame(rows, f"symbol {'long' if name is int else 'string'}, date date, value double")


@pytest.mark.parametrize("cells", [10, 2_000_000])
@pytest.mark.parametrize("name", [int, "s{}".format])
@pytest.mark.parametrize("iso", [False, True])
def test_long_lists_give_the_rows_of_the_pivot(spark, monkeypatch, name, cells, iso):
    points = history(spark, name).localCheckpoint()
    symbols = sorted(map(name, range(3, 32)), key=str)               # not the first ones, and some without a point
    want = LG.symbol_equity_wide(points, symbols, iso_dates=iso)
    monkeypatch.setattr(LG, "FEW_SYMBOLS", 1)
    monkeypatch.setattr(LG, "WIDE_CELLS", cells)
    got = LG.symbol_equity_wide(points.repartition(5), symbols, iso_dates=iso)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(got) == rows(want) and got.count() == 40


def test_the_first_of_several_values_stays_and_none_counts(spark, monkeypatch):
    monkeypatch.setattr(LG, "FEW_SYMBOLS", 0)
    points = spark.createDataFrame([(1, dt.date(2024, 1, 1), v) for v in (None, 2.0)] + [(1, dt.date(2024, 1, 2), v) for v in (3.0, 4.0)],
                                   "symbol long, date date, value double").coalesce(1)
    got = {r["date"].day: r["1"] for r in LG.symbol_equity_wide(points, [1]).collect()}
    assert got == {1: None, 2: 3.0}


def test_the_plan_has_no_expression_a_symbol(spark):
    plan = LG.symbol_equity_wide(history(spark, int), list(range(1001)), iso_dates=True)._jdf.queryExecution().optimizedPlan()
    assert "MapInArrow" in plan.nodeName() and "pivot" not in plan.toString().lower()
