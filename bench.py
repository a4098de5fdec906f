"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores), ``BENCH_QUERIES`` (names).
Results go to the ``noop`` sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arborlake.plans.catalog import QUERIES  # noqa: E402
from arborlake.session import local_session  # noqa: E402

HEADLINE = (
    "analyse_files", "run_summary", "exclude_folder_name", "matches_any_pattern", "filter_preview",
    "is_binary_cascade", "sample_statistics", "content_hash", "content_hash_xxh64",
    "base64_preview", "cache_hits", "cache_misses", "last_wins_upsert", "evict_to_limit",
    "tree_nodes", "tree_edges", "json_tree", "xml_tree", "jsonl_rows", "run_compare_metrics",
    "run_result_diff", "run_report", "keep_last_n", "running_count", "match_navigation",
    "run_numbering", "chunk_index", "stream_entries", "stream_log_routing",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # starts executors and Python workers, so that no query pays for that
    QUERIES["entry_scan_ordered"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64).repartition(int(cpus)).mapInPandas(lambda batches: batches, "id LONG").write.format(
        "noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
