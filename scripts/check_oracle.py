"""Run registered Spark queries and their DuckDB oracle SQL side by side.

usage: python scripts/check_oracle.py [sf_dir] [name-prefix ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts and timing.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm_value(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    return v


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(norm_value(v) for v in rec))
    rows.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, rows


def compare(sp: pd.DataFrame, ora: pd.DataFrame) -> str:
    c1, r1 = canon(sp)
    c2, r2 = canon(ora)
    if c1 != c2:
        return f"COLUMNS spark={c1} oracle={c2}"
    if len(r1) != len(r2):
        return f"ROWCOUNT spark={len(r1)} oracle={len(r2)}"
    bad = 0
    first = None
    maxdiff = 0.0
    for a, b in zip(r1, r2):
        if a != b:
            bad += 1
            if first is None:
                first = (a, b)
            for x, y in zip(a, b):
                if isinstance(x, float) and isinstance(y, float):
                    maxdiff = max(maxdiff, abs(x - y))
    if bad:
        percol = {}
        for a, b in zip(r1, r2):
            for c, x, y in zip(c1, a, b):
                if x != y:
                    percol[c] = percol.get(c, 0) + 1
        return f"VALUES {bad} rows differ per-col {percol} (max float diff {maxdiff:g}); first: {first}"
    return "OK"


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from quantflow.plans.registry import load_all
    from quantflow.session import get_spark
    reg = load_all()
    spark = get_spark("oracle-check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    n_ok = n_bad = 0
    for name, q in sorted(reg.items()):
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            sp = q.fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR   {name}: spark {type(e).__name__}: {str(e)[:400]}")
            n_bad += 1
            continue
        t1 = time.time()
        if q.sql is None:
            print(f"ROWS    {name}: spark rows={len(sp)} ({t1 - t0:.1f}s, no oracle)")
            continue
        try:
            ora = con.execute(q.sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR   {name}: duckdb {type(e).__name__}: {str(e)[:400]}")
            n_bad += 1
            continue
        res = compare(sp, ora)
        tag = "OK" if res == "OK" else "MISMATCH"
        n_ok += tag == "OK"
        n_bad += tag != "OK"
        print(f"{tag:8s}{name}: rows={len(sp)} ({t1 - t0:.1f}s) {'' if tag == 'OK' else res[:600]}")
        sys.stdout.flush()
    print(f"done: ok={n_ok} bad={n_bad}")


if __name__ == "__main__":
    main()
