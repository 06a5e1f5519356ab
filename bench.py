"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from strataview.plans.profile import profile
from strataview.queries import QUERIES
from strataview.sources.tables import spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["spec_lineitem", "spec_postproc_lineitem", "spec_orders", "spec_customer", "hll_b8", "bottomk_16", "node_extremes_span", "dict_values", "flatten_record", "flatten_map_props", "flatten_array_embeddings", "hist_bitsize_documents", "merge_spec", "joinup_integer_rollup", "timeline_rows", "attrs_key_ts"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    times = {}
    lineitem = spread(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"))
    rows = lineitem.count()

    def whole_record():
        spec = profile(lineitem, (0, {"ts": "l_shipdate", "key": "l_orderkey"}), limit=None, name="lineitem")
        for df in spec.tables().values():
            df.write.format("noop").mode("overwrite").save()

    for name in ["profile_lineitem", *NAMES]:
        spark.catalog.clearCache()
        best = None
        for _ in range(2):
            start = time.time()
            if name == "profile_lineitem":
                whole_record()
            else:
                QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of 2", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2], "profile_records_per_second": round(rows / times["profile_lineitem"])}))


if __name__ == "__main__":
    main()
