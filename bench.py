"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The derived tables are built first and reported apart. Each query runs once to warm up, then ``REPEATS`` times; the median counts.
"""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ("count_by_region", "regex_full", "nested_region_attr", "child", "seq2", "run_max", "chain_rep", "within_s", "gov", "gov_trans", "count_rollup", "freq_subcorpus", "stats_by", "coll_measures", "dcoll", "keyness_rest", "tabulate", "kwic", "parallel")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans import catalog

    began = time.time()
    catalog.corpus(spark, sf)
    catalog.corpus(spark, sf, "conversations")
    build = time.time() - began
    queries = {}
    for name in HEADLINE:
        took = []
        for _ in range(REPEATS + 1):
            began = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        queries[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": sf, "build_sec": round(build, 3)}))


if __name__ == "__main__":
    main()
