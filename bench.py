"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nestgrain.plans.registry import REGISTERED  # noqa: E402
from nestgrain.session import build_session  # noqa: E402

HEADLINE = [
    "metric_summary", "metric_strata", "participant_errors", "bootstrap_ci", "bootstrap_strata_ci", "greedy_folds", "group_kfold", "null_model",
    "two_level_pool", "masked_summary", "boundary_points", "interval_thickness", "vector_pool", "exact_percentiles", "row_index",
    "nearest_three", "footprint_samples", "affine_fit", "registration_error", "range_join", "tolerance_join", "one_to_one_join", "anti_exclusion",
    "reconcile_manifest", "qc_exceptions", "review_queue", "signature_groups", "cosine_top3", "scan_assignment", "line_ladder", "primary_ladder",
    "secondary_ladder", "release_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("nestgrain-bench", f"local[{cores}]", cores)
    spark.sparkContext.setLogLevel("ERROR")
    REGISTERED["metric_summary"][0](spark, sf_dir).collect()  # start the JVM paths before timing
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        REGISTERED[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
