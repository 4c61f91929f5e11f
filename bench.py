"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (tables) and ``BENCH_CPUS`` (local cores). Every query is
run whole into a sink that discards rows; the faster of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from docfathom import build_session
from docfathom.plans.registry import QUERIES

HEADLINE = [
    "search_topk",
    "search_topk_batch",
    "search_topk_blocks",
    "search_text_topk",
    "search_ann",
    "cached_search",
    "search_response_json",
    "hash_embedding",
    "embed_documents",
    "document_lifecycle",
    "upsert_documents",
    "apply_embeddings",
    "delete_report",
    "embed_jobs_dedup",
    "tenant_fifo",
    "jobs_fetch_text",
    "pending_backfill",
    "signal_latency_p99",
]
RUNS = 2


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "docfathom-bench",
        master=f"local[{cpus}]",
        settings={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed = {}
    for name in HEADLINE:
        timed[name] = round(min(seconds(spark, name, sf_dir) for _ in range(RUNS)), 3)
        print(f"{name} {timed[name]}", file=sys.stderr)
    recall = QUERIES["ann_recall"](spark, sf_dir).first().recall
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "documents_embedded_per_sec": round(documents / timed["embed_documents"]),
                "ann_recall": round(recall, 4),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
