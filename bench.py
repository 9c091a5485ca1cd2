"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the threads. Each query runs once to warm up on the smallest
tables there are and once timed, whole result written to a sink that keeps
nothing.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

from quire.plans import registry
from quire.session import build

HEADLINE = [
    "find_top_k",
    "answering_row",
    "ever_vs_same",
    "mask_predicates",
    "fold_best",
    "global_order",
    "run_offsets",
    "best_per_group",
    "grouped_totals",
    "worth_distinct",
    "nearest_rank",
    "decode_dictionary",
    "array_dictionary",
    "collapse_identity",
    "first_fit",
    "reconcile",
    "landing",
    "spend_lots",
    "catalog_joins",
    "checked_rows",
    "hamming_top_k",
    "repeated_passages",
    "repeated_within",
    "fulltext_top_k",
    "normalize_text",
    "csv_round_trip",
    "bulk_scan",
    "encoded_catalog",
    "stream_drain",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build("bench", f"local[{cpus}]", partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    warm = pathlib.Path(root).parent / "sf0.001"
    queries = registry()
    took = {}
    for name in names:
        run = queries[name][0]
        for where in ([str(warm)] if warm.exists() else []) + [root]:
            start = time.perf_counter()
            run(spark, where).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = pathlib.Path(root).name.removeprefix("sf")
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
