"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to the end into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import time

from tidewell.catalog import QUERIES
from tidewell.session import get_spark

HEADLINE = [
    "hybrid_search",
    "dense_topk",
    "bm25_topk",
    "document_postings",
    "masked_documents",
    "normalized_text",
    "semantic_chunks",
    "hierarchical_chunks",
    "html_blocks",
    "csv_blocks",
    "transcript_blocks",
    "context_precision",
    "evaluated_runs",
    "score_drift",
    "observer_scan",
    "median_latency",
    "merge_first_wins",
    "rerank_topk",
    "ingested_documents",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query starts the JVM's code paths and the Python workers.
    QUERIES["html_blocks"](spark, sf).limit(1).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
