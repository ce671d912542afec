"""Times the headline queries and prints one line of JSON.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores. Each query runs
once unmeasured and then three times; the median counts.
"""

from __future__ import annotations

import importlib
import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "str6_html_to_text", "str13_chunk_words", "win2_latest_by_hash", "vec3_hash_encoder", "top1_dense_top_k",
    "join1_block_grid", "top1_sparse_top_k", "win1_history", "win4_pack", "win3_first_n", "prj2_good_rows",
    "snk3_upsert_latest", "stm2_same_graph_batch", "agg2_perplexity", "src1_backfill", "flagship_prompts",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    queries = importlib.import_module("__spark_entry__").queries()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rsplit("/", 1)[-1].removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
