"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
BENCH_ALL=1 times every query of the catalogue instead.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from lodestone.plans.registry import load, runner
from lodestone.session import build_session

HEADLINE = [
    "ensemble_vote", "tree_stats", "capped_files", "feature_assembly", "classify",
    "quality_profile", "stream_resume", "package_rollup", "markdown_strip", "manifest_counts",
    "manifest_union", "manifest_match", "usage_scores", "usage_counts", "producer_score", "grid_search",
    "originality_pipeline", "tuned_pipeline", "leave_two_out",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(load()) if os.environ.get("BENCH_ALL") else HEADLINE
    names = sys.argv[1:] or names
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": scale and float(scale.group(1))}))


if __name__ == "__main__":
    main()
