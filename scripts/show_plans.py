"""Print the physical plan tree of registered queries (operator lines + scan schemas).

usage: python scripts/show_plans.py [sf_dir] name ...
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from quantflow.plans.registry import load_all
    from quantflow.session import get_spark
    spark = get_spark("plans")
    reg = load_all()
    for name in args:
        df = reg[name].fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {name}\n```")
        for line in plan.splitlines():
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r", \[plan_id=\d+\]", "", line)
            if "FileScan" in line:
                schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
                pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
                line = line.split("FileScan")[0] + "FileScan parquet " + \
                    (f"PushedFilters: {pushed.group(1)} " if pushed else "") + \
                    (f"ReadSchema: {schema.group(1)}" if schema else "")
            print(line[:200])
        print("```\n")


if __name__ == "__main__":
    main()
