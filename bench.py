"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed to completion through the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from impressa.plans.registry import load_all  # noqa: E402
from impressa.session import get_session  # noqa: E402

HEADLINE = [
    "m10_test_bundle",          # flagship: 19 metrics of a ranker over every impression
    "m13_random_baseline",
    "m14_npmi_ranker_eval",     # learn NPMI, score, evaluate
    "g19_npmi",
    "d1_negative_draw",
    "d3_sample_exact",
    "v5_word_ids",
    "v7_encode_abstracts",
    "b10_score_candidates",
    "j3_impression_view",
    "g11_survival_histogram",
    "p1_parse_impressions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="impressa-bench", shuffle_partitions=max(8, cpus * 2),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    queries = load_all()
    # warm-up: JVM, parquet footers, Python workers
    queries["p6_parse_time"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
