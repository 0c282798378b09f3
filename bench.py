"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptorium import catalog  # noqa: E402
from scriptorium.session import build_session  # noqa: E402

HEADLINE = (
    "hybrid_rrf", "bm25_topk", "vector_topk", "vector_topk_filtered", "rerank_lexical", "context_budget", "recall_at_k", "quality_score", "preprocess_text", "word_window_chunks",
    "content_hash_dedup", "jaccard_pairs", "smart_merge", "coverage_gaps", "upsert_coalesce", "status_bucket_counts", "latency_percentiles", "downsample", "alert_edges",
    "citation_compliance", "entities", "stream_tumbling",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")))
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2],
        "search_sec_per_question": {q: round(took[q] / max(questions, 1), 5) for q in ("vector_topk", "bm25_topk", "hybrid_rrf")},
    }))


if __name__ == "__main__":
    main()
