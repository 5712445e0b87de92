"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line {"metric", "value", "unit", "queries", "sf"}.

Every query is executed in full through the no-op sink (no collect), after
an untimed warm-up on the smallest scale.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "corpus_counts", "dedup_first", "take_quota", "round_robin_quota", "value_counts_multi",
    "candidate_dictionary", "weighted_interleave", "score_pairs", "ir_metrics", "global_rank",
    "rerank_metrics", "pack_blocks", "grouped_split_search", "permutation_test", "plan_pending",
    "stream_corpus",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    from weft.plans import registry
    from weft.session import local_session
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="weft-bench")
    qs = registry.queries()
    # untimed warm-up on the smallest tables: JIT, Python workers, checkpoint folder
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in ("corpus_counts", "score_pairs"):
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
