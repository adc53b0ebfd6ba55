"""Time the headline queries: python bench.py; reads BENCH_SF_DIR and BENCH_CPUS, prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ragloom.plans import datasets, registry  # noqa: E402

HEADLINE = [
    "bm25_topk", "bm25_filtered", "vector_topk", "hybrid_search", "rerank", "retrieval_study", "retrieval_metrics",
    "verbatim_qrels", "content_f1", "rouge_l", "score_runs", "aggregate_runs", "paired_bootstrap", "latency_summary",
    "chunk_semantic", "chunk_by_title", "chunk_sentences", "build_chunks", "neighbourhood", "next_allowed",
    "gate_positions", "gating_hint", "classify_in_context", "history_window_prompt", "similarity_edges",
    "overlap_edges_keyphrases", "match_contexts", "upsert_scores",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="ragloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ragloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        datasets.clear_stored()  # each query pays for what it reads
        start = time.perf_counter()
        registry.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, wall-clock total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(directory)).removeprefix("sf"),
    }))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
