"""Registered queries: contract shape, and every query with SQL against DuckDB at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import TABLES, compare  # noqa: E402

from quantflow.plans.registry import load_all  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

ORACLES = sorted(name for name, q in load_all().items() if q.sql)


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    df = E.entry(spark)
    assert df.count() > 0 and "signal" in df.columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, duck, name):
    q = load_all()[name]
    sp = q.fn(spark, SF_SMALL).toPandas()
    ora = duck.execute(q.sql).df()
    assert compare(sp, ora) == "OK"
