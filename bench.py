"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import tempfile
import time

from caseloom.plans import registry
from caseloom.session import build_session

HEADLINE = [
    "graph_edges", "graph_nodes", "edge_merge", "graph_view_topn", "graph_view_dates", "khop_2", "entity_detail", "related_entities",
    "fts_search", "fts_segments", "vector_topk", "vector_neighbours", "mode_hybrid", "dup_check", "dup_reject", "token_chunks",
    "compose_text", "span_in_source", "er_candidates", "eval_source", "eval_entities", "delete_cascade", "stage_usage", "stream_dedupe",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # one small query first, so that the first timing is not the start of the JVM
    queries["stage_usage"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
