"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_RUNS (default 2).
Each query is built and run to a no-op sink; the value is the warm median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from parlance.plans.queries import QUERIES
from parlance.session import local_session

HEADLINE = [
    "pii_type_summary", "guardrail_verdict", "injection_matches", "response_leaks", "keyword_tags", "language_profile",
    "user_profile", "session_history", "session_segments", "repetition_score", "conversation_summary", "turn_decisions",
    "vocab", "encoded_sequences", "intent_scores", "augmented_corpus", "stratified_split", "chatml_corpus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
