"""Headline queries, timed warm; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Every query runs ``BENCH_RUNS`` (default 3) times on
results written to nowhere; the best run counts, ``first_runs`` has the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenseek import catalog  # noqa: E402
from lumenseek.session import build_session  # noqa: E402

HEADLINE = [
    "vector_topk", "vector_topk_default_threshold", "batch_vector_topk", "keyword_scan", "hybrid_rrf", "rerank",
    "results_by_file", "hash_embed", "rerank_signals", "tokenize", "token_estimate", "embedding_input",
    "file_scan_report", "scan_skip_reasons", "fixed_chunks", "breakpoint_chunks", "split_large_chunks",
    "chunk_source_code", "type_histogram", "index_stats", "batch_assignment", "latest_change_per_file",
    "upsert_file",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.all_queries()
    times, first = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            first.setdefault(name, round(took, 3))
            best = min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "first_runs": first, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
