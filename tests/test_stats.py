"""Statistics goldens (reference performance tests and hand-derived values)."""

import datetime as dt

from quantflow.operators import stats as ST

D0 = dt.date(2025, 1, 1)


def _eq(spark, values, series="s"):
    return spark.createDataFrame([(series, D0 + dt.timedelta(days=i), float(v))
                                  for i, v in enumerate(values)],
                                 "series string, date date, equity double")


def test_returns_rounded(spark):
    r = [x["ret"] for x in ST.daily_returns(_eq(spark, [50000, 52000, 51000, 48000]))
         .orderBy("date").collect()]
    assert r == [0.0, 0.04, -0.0192, -0.0588]


def test_max_drawdown_and_duration(spark):
    m = ST.max_drawdown(_eq(spark, [50000, 52000, 51000, 48000])).first()
    assert m["max_dd"] == -0.0769 and m["max_dd_duration"] == 2


def test_flat_curve(spark):
    s = ST.summary(_eq(spark, [100000, 100000, 100000])).first()
    assert s["max_dd"] == 0.0 and s["sharpe"] is None and s["volatility"] == 0.0


def test_falling_curve(spark):
    s = ST.summary(_eq(spark, [100000, 95000, 90000])).first()
    assert s["max_dd"] == -0.1


def test_summary_matches_pandas(spark):
    import numpy as np
    import pandas as pd
    vals = [100000, 101000, 101200, 100800, 99000, 102000, 103500, 101000]
    s = pd.Series(vals, dtype=float)
    r = s.pct_change().fillna(0).round(4)
    sharpe = round(r.mean() / r.std() * np.sqrt(252), 4)
    vol = round(r.std() * np.sqrt(252), 4)
    ann = round((1 + ((1 + r).prod() - 1)) ** (252 / len(r)) - 1, 4)
    got = ST.summary(_eq(spark, vals)).first()
    assert got["sharpe"] == sharpe and got["volatility"] == vol and got["annual_return"] == ann


def test_monthly_matrix_gap_is_zero(spark):
    rows = [("s", dt.date(2024, 1, 5), 100.0), ("s", dt.date(2024, 1, 20), 110.0),
            ("s", dt.date(2024, 3, 3), 121.0)]
    eq = spark.createDataFrame(rows, "series string, date date, equity double")
    m = ST.monthly_matrix(ST.daily_returns(eq)).first()
    assert m["Jan"] == 0.1 and m["Feb"] == 0.0 and m["Mar"] == 0.1 and m["Apr"] is None


def test_aggregate_returns_rejects_unknown(spark):
    import pytest
    with pytest.raises(ValueError):
        ST.aggregate_returns(ST.daily_returns(_eq(spark, [1, 2])), "daily")


def test_cagr_takes_the_curve_as_it_is(spark):
    eq = spark.createDataFrame([("a", dt, 2.0 + i) for i, dt in enumerate(["2024-01-01", "2024-01-02", "2024-01-03"])],
                               "series string, date string, equity double")
    assert ST.cagr(eq).first()["cagr"] == round(4.0 ** 84 - 1, 4)
    assert ST.cagr(eq, normalise=True).first()["cagr"] == round(2.0 ** 84 - 1, 4)
