"""Time the headline queries; prints one JSON line.

Each query is planned and run in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vinculum.session import build_session, scratch_run  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "pathway_disease_inference",
    "harmonise_ids",
    "edge_build_union_dedupe",
    "orphan_edge_removal",
    "edge_label_suffix",
    "nested_pathway_edges",
    "relation_edges",
    "node_merge",
    "quality_report",
    "table_profile",
    "taxonomy",
    "term_dictionary",
    "latest_year_wins",
    "vocab_enrichment",
    "drug_xml_roundtrip",
    "mesh_xml_roundtrip",
    "sdf_properties",
    "association_scan",
    "path_search_1",
    "path_search_2",
    "path_search_3",
    "entity_connections",
    "bm25_topk",
    "vector_topk",
    "hybrid_topk",
    "merge_rerank",
    "corpus_build",
    "graph_build_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("harmonise_ids")
    seconds = {}
    for name in names:
        times = []
        for _ in range(repeats):
            with scratch_run(spark):
                started = time.perf_counter()
                run(name)
                times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
