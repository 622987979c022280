"""Times registered queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated names,
``all`` for every registered query; default: the headline queries).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "metric_trend", "ag1_basic_stats", "ag3_daily_bucket", "ag4_mad_outliers", "win1_latest", "win6_near_duplicates",
    "win7_window_features", "win8_rolling_origin_folds", "win12_alert_suppression", "ts9_trend_class", "ts11_curve_analysis",
    "jn1_wave_pair", "jn2_incident_outcome", "ag14_error_set", "ag16_conformal_quantile", "ag19_auroc", "ag25_decision_curve",
    "ag28_subgroup_audit", "ml1_stable_hash_split", "ag7_cohort_profile", "ag32_domain_scores", "kg2_tokens",
    "kg8_type_conflicts", "kg13_bounded_expansion", "kg16_hybrid_retrieval", "kg23_golden_expectations", "kg28_user_context",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=int(os.environ.get("BENCH_CPUS", "8")))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    QUERIES["win1_latest"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total wall time of the headline queries" if not wanted else "total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else sf_dir,
    }))


if __name__ == "__main__":
    main()
