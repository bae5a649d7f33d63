"""Headline queries, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "error_slices", "metrics_by_run", "roc_curve", "noise_floor", "compare_runs", "ensemble_verdict",
    "conflict_rate_cls", "duplicate_rows", "signal_check", "label_noise", "learning_curve", "feature_signal",
    "permutation_importance", "paired_gain", "stagnation_streak", "run_vs_parent", "protocol_audit",
    "stream_event_counts",
)


def main() -> None:
    from assaykit.plans.catalog import load
    from assaykit.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    # warm the JVM on the smallest tables next to the measured ones, when they are there
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for key in HEADLINE:
            catalog[key].run(spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        catalog[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
