"""Bars are derived once."""

import datetime as dt

import pytest

from quantflow.plans import q_backtest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    day = dt.datetime(2024, 1, 1)
    rows = [(d * 3 + s, d, s, 1, float(1 + (d * s) % 7), 1000.0 + 37 * ((d * (s + 3)) % 11), "R" if d % 4 == 0 else "N", "O", day + dt.timedelta(days=d))
            for s in (1, 2) for d in range(60)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
                                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{root}/lineitem.parquet")
    return root


def test_gates_read_bars_that_are_derived_once(spark, sf_dir):
    made = q_backtest.rsk2(spark, sf_dir)
    assert "lineitem.parquet" not in made._jdf.queryExecution().toString()
    assert made.count() > 0
