"""Run the headline queries and print one JSON line with their wall seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from strandweave.session import local_session
from strandweave.workload.queries import REGISTRY

HEADLINE = [
    "read_stats",
    "longest_budget",
    "coverage_estimate",
    "filter_reasons",
    "best_per_pair",
    "interval_depth",
    "interval_depth_suppliers",
    "covered_region",
    "overlap_class_counts",
    "kept_overlaps",
    "bigraph_edges",
    "multi_edge_dedup",
    "short_edge_removal",
    "weak_edge_removal",
    "degree_histogram",
    "transitive_reduce",
    "transitive_reduce_dense",
    "node_class",
    "tip_trim",
    "components",
    "chains",
    "unitig_members",
    "bubble_paths",
    "bubble_removal",
    "bridge_support",
    "n50_by_lang",
    "seed_overlaps",
    "assemble_unitigs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).groupBy().count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
