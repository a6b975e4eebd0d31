"""Headline queries, timed one by one; prints a single JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` choose data and cores.
``python bench.py all`` times every registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from foldline.plans import catalog
from foldline.session import build_session

HEADLINE = (
    "column_profile",
    "correlation_matrix",
    "drift_scan",
    "group_statistics",
    "text_statistics",
    "rolling_by_user",
    "rolling_global",
    "exponential_means",
    "technical_indicators",
    "gap_geometry",
    "interpolating_join",
    "average_ranks",
    "classification_metrics",
    "time_segment_scores",
    "kfold_grouped",
    "simplex_weight_grid",
    "cross_fitted_stack",
    "nested_candidate_selection",
    "candidate_pair_comparison",
    "anti_failed_extrapolation",
    "submission_findings",
    "submission_decisions",
    "experiment_tree",
    "nearest_donors",
    "local_plane_regression",
    "ridge_two_features",
    "wide_correlation_matrix_with_nulls",
    "near_duplicate_columns_with_nulls",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = catalog.load()
    names = list(registry) if sys.argv[1:] == ["all"] else [n for n in HEADLINE if n in registry]
    registry["column_profile"].run(spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if sys.argv[1:] == ["all"]:
            print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
