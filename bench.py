"""Headline queries over the tables in BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tideloom.plans.queries import QUERIES

#: The experiment matrix's queries for all instants, and some at slide boundaries.
NAMES = ["vt_query1", "vt_query2", "vt_query2_a", "vt_query3", "vt_query3_a", "vt_query4", "vt_query4_a", "vt_query4_pc1", "vt_query4_pc2", "bs_query2", "bs_query3", "bs_query4", "deltas", "orders_path"]


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["join"](spark, sf_dir).count()  # starts what every query needs
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
