"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkstone.plans.registry import Tables, load_catalog  # noqa: E402
from inkstone.session import local_session  # noqa: E402

HEADLINE = (
    "clean_lines", "split_sentences", "pii_scrub", "chunk_tokens", "page_split", "usage_log_scan",
    "chunk_spans", "mention_counts", "first_occurrence", "entity_positions", "section_asof", "span_overlap",
    "order_members", "export_order", "header_sections", "entity_pages", "match_cascade", "match_collisions",
    "provenance", "route_question", "vector_topk", "graph_build", "degrees", "largest_component",
    "usage_by_model", "majority_keep", "pair_jaccard", "greedy_match", "size_distribution", "building_slots",
    "top_per_cluster", "dual_rank", "unique_ids", "candidate_topk", "evidence_union", "absorb_rooms",
    "cache_split", "rate_limit", "job_progress", "usage_stream", "base_cluster", "merge_to_k",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog, times = load_catalog(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name].run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
