"""Times the headline graph queries and prints one line of JSON.

The graph is derived from the tables and written once (graph_build); each query then starts from it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from weftgraph.plans import catalog

QUERIES = ("degree_stats", "tc_array", "tc_join", "tc_per_vertex", "k4_count", "gm_count", "gm_matches_by_a", "mc_bnb", "hash_cut_stats", "cc_hashmin", "label_nb_counts", "block_info")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["degree_stats"](spark, sf_dir).collect()  # warms the JVM
    start = time.time()
    graph = catalog.graph(spark, sf_dir)
    took = {"graph_build": round(time.time() - start, 2)}
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        queries[name].on(graph).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
