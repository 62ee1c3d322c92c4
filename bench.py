"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import registry
from tessera.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "vector_topk", "knn_batch", "similar_pairs", "bm25_topk", "rrf_fusion", "ir_metrics", "keyword_weights", "exact_duplicates",
    "pagerank_10it", "degree_centrality", "graph_stats", "components", "paths_bounded", "communities", "cochange_pairs", "coupling",
    "dead_code", "cohesion", "quality_stats", "findings_grouping_sets", "rate_limit_windows", "asof_enclosing", "range_overlap", "debounce_sessions",
)


def main() -> None:
    spark = build_session(f"local[{CPUS}]", int(CPUS), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        began = time.time()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
