"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line. Each runs once to warm up and then
BENCH_RUNS times (1 by default); the median counts. Results are written to the noop sink, so that all rows are made."""

from __future__ import annotations

import json
import os
import statistics
import time

from quern.plans import catalogue
from quern.session import build_session

HEADLINE = (
    "chunk_fixed", "chunk_sentences", "chunk_lumber_cap", "chunk_recursive", "chunk_semantic", "html_to_text", "header_trim", "useful_filter", "bm25_stats", "bm25_topk_concat", "bm25_topk_score", "chunk_bm25", "dense_topk_merge", "retrieval_scores",
    "context_join", "rouge1", "rouge_l", "metric_summary", "nli_final_intersect", "qa_merge_ids", "pair_hash", "latest_row", "rate_limit", "paired_wide", "wilcoxon_stat", "box_stats",
)


def calibration(spark) -> float:
    """Seconds for a sum over hashes of fixed numbers, which no change to the library touches: tells machines apart."""
    runs = []
    for _ in range(3):
        began = time.perf_counter()
        spark.range(60_000_000).selectExpr("sum(xxhash64(id) % 1000)").collect()
        runs.append(time.perf_counter() - began)
    return round(min(runs), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    machine = calibration(spark)
    for name in HEADLINE:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "1"))):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration": machine, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
