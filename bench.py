"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default HEADLINE).
Each query is planned and fully executed into a no-op sink (every row
computed, nothing collected); the time covers both. An untimed warm-up
(one small chunking query on sf0.001) runs first so JVM, JIT and Python-worker
start-up are not charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_lines_1000_200",
    "chunk_lines_100_10",
    "chunk_recursive_150_15",
    "chunk_matrix",
    "chunk_vs_original_cosine",
    "answer_cosine",
    "knn_exact_k8",
    "qa_extract",
    "score_extract",
    "flagship_strategy_ranking",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from slicewise.plans import catalog
    from slicewise.session import get_session, release_tables

    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="slicewise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # untimed warm-up: JVM, JIT and the Python worker (first Arrow UDF) on the smallest data set
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        catalog.QUERIES["chunk_lines_100_10"](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
        release_tables(spark)          # materialised intermediates of this query (untimed)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
