"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or `all`).
Each query runs once untimed on the same data, then once timed, with its full result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "train_validate",
    "src_scan_profile",
    "stat_basic",
    "stat_median",
    "split_ab",
    "prep_fill_mean",
    "prep_clip_mean",
    "prep_clip_tukey",
    "prep_buckets",
    "prep_minmax",
    "prep_standardize",
    "prep_rbf_apply",
    "eval_info_gain",
    "validate_auc",
    "validate_ks",
    "validate_thresholds",
    "trial_topk",
    "trial_dedup",
    "trial_max_gap",
    "trial_convergence",
    "strategy_reward",
    "propose_crossover",
    "propose_mutation",
    "propose_gap_midpoint",
    "propose_ignite_regression",
    "surrogate_linear",
    "chain_trial",
    "generation_candidates",
]


def main() -> None:
    from tunekit.catalog.all import QUERIES
    from tunekit.sources.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, app="tunekit-bench")
    took: dict[str, float] = {}

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return time.perf_counter() - start

    for name in names:
        once(name)
        took[name] = round(once(name), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(sf.group(1)) if sf else sf_dir,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
