"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: data folder. BENCH_CPUS: local cores. BENCH_RUNS: timed runs of each query, of which the
median counts (default 1). BENCH_QUERIES: names to run instead of the headline ones. One query warms the
session up. Shared intermediates are dropped before each run, so each query pays for its own.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from corpusgraph.plans import corpora
from corpusgraph.plans.catalog import QUERIES

HEADLINE = [
    "phrase_scores", "structural_blocks", "semantic_chunks", "chunk_documents", "exact_dedup", "greedy_merge",
    "entities_by_chunk", "relations_by_chunk", "reuse_by_hash", "entity_nodes", "communities", "entity_scores",
    "top_relations", "snapshot_nodes", "vector_topk", "scoped_topk", "filtered_topk", "hybrid_hits",
    "induced_edges", "citations", "query_confidence", "retention", "change_only", "stream_session_counts",
]


def timed(spark: SparkSession, name: str, folder: str) -> float:
    corpora.forget()
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "7g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds = {}
    timed(spark, "entities_by_chunk", folder)
    for name in names:
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
