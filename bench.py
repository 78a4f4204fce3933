"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through Spark's ``noop`` sink (full execution, nothing
collected to the driver). An untimed warm-up pass runs the same queries on the smallest
scale factor first, so timings exclude JVM/JIT warm-up and Python worker start-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantflow.plans.registry import load_all  # noqa: E402
from quantflow.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("quantflow-bench", cores=cpus, shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    names = [n for n, q in sorted(reg.items()) if q.bench]
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for n in names:
        reg[n].fn(spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"{n}: {times[n]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": int(cpus), "warmup": f"one untimed pass on {warm_dir}"}))
    spark.stop()


if __name__ == "__main__":
    main()
