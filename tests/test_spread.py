import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strataview.sources.tables import spread


def test_rows_of_one_row_group_reach_all_tasks(spark, tmp_path):
    """A file of one row group that Spark cuts into as many splits as cores: all but one are empty."""
    pq.write_table(pa.table({"k": list(range(20_000))}), str(tmp_path / "one.parquet"), use_dictionary=False, compression="none")
    cores = spark.sparkContext.defaultParallelism
    old = {name: spark.conf.get(name) for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        scan = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert cores <= scan.rdd.getNumPartitions() < 2 * cores
        rows = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) >= cores and sum(rows) == 20_000 and max(rows) < 20_000 / cores * 1.5
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
