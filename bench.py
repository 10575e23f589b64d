"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from korpusa import catalog
from korpusa.session import get_session

HEADLINE = (
    "bm25_topk lexical_overlap_topk vector_topk rrf_hybrid hybrid_retrieval context_assembly neighbor_stitch ngram_anchors html_clean token_counts line_sections packed_lines "
    "chunk_documents context_recall hit_rate_mrr conversation_quality doc_catalog_counts sync_states event_type_summary failed_by_user_alert next_purchase session_history_last_n "
    "events_tumbling events_session pricing_summary segment_revenue order_cube running_balance top_parts_per_brand"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(max(8, int(cpus))), spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # starts the JVM's readers before the first timing
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
