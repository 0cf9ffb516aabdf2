"""Headline queries on one machine: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
data and cores. Every query is built and its whole result written to a sink
that discards it; one untimed run of a small query warms up the JVM and the
Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lexspark.plans import registry
from lexspark.session import local_session

HEADLINE = [
    "c1_postings", "c1_stored_index", "c2_bm25_statistics", "c3_bm25_top_k", "c4_phrase_search", "c5_keyword_overlap", "c7_vector_knn", "c10_session_knn",
    "c13_rank_fusion", "c14_hybrid_search", "c16_cascade", "d6_citation_pairs", "d7_cites_edges", "d9_provision_search", "d11_two_hops",
    "d12_graph_boost", "d18_shortest_paths", "e1_citation_audit", "e2_claim_trace", "e3_full_audit", "f5_lexical_scores", "f10_relaxed_keywords",
    "f13_summary", "f20_ablation", "f22_ngram_containment", "f25_batch_answers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = registry.queries()
    if names == ["all"]:
        names = list(queries)
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("c7_vector_knn")
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
