"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from lorekeep.plans import catalog
from lorekeep.session import local_session

HEADLINE = [
    "hybrid_search", "bm25_topk", "dense_topk", "hybrid_rank", "retrieval_metrics", "answer_context", "named_entities", "graph_closure", "provenance", "spread_sum",
    "spread_distinct", "near_duplicates", "recall", "working_memory", "event_sequence", "host_counters", "rounds", "episodes", "greedy_budget", "doc_dedupe",
    "document_tree", "page_text", "applicability", "term_resolution",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8, app="lorekeep-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
