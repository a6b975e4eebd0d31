"""List physical operators that do not scale: ``python -m tests.plans [-d DIR] [names]``.

Flags nested-loop joins, Cartesian products and windows without partition keys.
"""

from __future__ import annotations

import argparse
import re
import time

from foldline.plans import catalog
from foldline.session import build_session

WATCHED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def findings(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = [w for w in WATCHED if w in plan]
    for line in plan.splitlines():
        # offset tables hold one row per range partition or chunk
        if "__pid" in line or "__chunk" in line:
            continue
        m = re.search(r"Window \[.*?windowspecdefinition\((.*)", line)
        # a partitioned window lists its keys in a second bracket before the order
        if m and re.search(r"\], \[\], \[|\], \[[^\[\]]* ASC NULLS FIRST\]$", line) and line.count("], [") == 1:
            out.append("global window: " + line.strip()[:160])
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("plans", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in catalog.load().items():
        if args.names and name not in args.names:
            continue
        t0 = time.time()
        got = findings(q.run(spark, args.d))
        if got or time.time() - t0 > 15:
            print(f"{name} ({time.time() - t0:.0f}s): {'; '.join(got)}", flush=True)


if __name__ == "__main__":
    main()
