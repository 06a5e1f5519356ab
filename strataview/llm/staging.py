"""Shared-storage staging for multi-job operators.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``; that folder is visible to the driver and to
every executor, so a lost executor costs a re-read and nothing else.  Only when
the setting is absent (unit tests on ``local[*]``) a private folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder shared by all nodes."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = "file://" + tempfile.mkdtemp(prefix="strataview-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and return a scan of it (lineage is cut)."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(staged: DataFrame) -> None:
    """Delete a staged table that nothing will read any more; a folder that is gone already is no error."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged._stage_path)
    path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes from now on, unless the session has a lower bound: whole texts come in batches
    of 10,000 rows otherwise, which the executor and its workers hold several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus`` (null: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key with more than one in so many rows can skew a join; at most so many such keys exist.
HOT_SHARE = 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` (unique by ``key``; ``size``: rows of that key).

    Keys above a fixed share of all ``total`` rows are joined by broadcast, being
    at most HOT_SHARE by arithmetic; no other key can crowd a task.
    """
    columns = [c for c in groups.columns if c != key]
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot = groups.where(is_hot).select(F.col(key).alias("__hot_key"), *(F.col(c).alias(f"__hot_{c}") for c in columns))
    cold = groups.where(~is_hot).select(F.col(key).alias("__cold_key"), *(F.col(c).alias(f"__cold_{c}") for c in columns))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    # rows of hot keys go by a random-looking salt that no cold key can match
    out = out.withColumn("__salt", F.when(F.col("__hot_key").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    cold = cold.withColumn("__zero", F.lit(0).cast("long"))
    out = out.join(cold, (F.col(key) == F.col("__cold_key")) & (F.col("__salt") == F.col("__zero")), "left")
    return out.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in columns))


#: Rows of ids that may be broadcast (counted before).
BROADCAST_ROWS = 100_000


def drop_rows(docs: DataFrame, dropped: DataFrame, on: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose values equal a row of ``dropped`` (null-safe).

    ``on``: column of ``dropped`` to the expression over ``docs``.  Few rows are broadcast, more
    are joined by shuffle.
    """
    names = {name: f"__dropped_{name}" for name in on}
    dropped = stage(dropped.select(*(F.col(n).alias(new) for n, new in names.items())).distinct(), "dropped")
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    match = F.lit(True)
    for name, expression in on.items():
        match = match & expression.eqNullSafe(F.col(names[name]))
    return docs.join(dropped, match, "left_anti")


def keep_rows(docs: DataFrame, kept: DataFrame, name: str, on: Column) -> DataFrame:
    """``docs`` whose ``on`` equals a value of column ``name`` of ``kept`` (null-safe); few are broadcast."""
    kept = stage(kept.select(F.col(name).alias("__kept")).distinct(), "kept")
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    return docs.join(kept, on.eqNullSafe(F.col("__kept")), "left_semi")


#: Bits of a row's number that count rows within a file.
ROW_BITS = 40


def numbered(docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs`` with a number for each row, other for equal rows too and the same whenever it is evaluated.

    The number is made of a file's place among the sorted file names and the row's place in its file, which do not depend on how
    files are dealt to tasks.  Rows that do not come straight from Parquet files are staged first.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    try:
        rows = docs.select(*columns, *place)
    except AnalysisException:
        rows = stage(docs, "rows").select(*columns, *place)
    files = rows.select("__file").distinct()
    files = stage(files.select("__file", F.row_number().over(Window.orderBy("__file")).cast("long").alias("__nth")), "files")  # names alone
    if files.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        files = F.broadcast(files)
    return rows.join(files, "__file").select(*columns, (F.shiftleft("__nth", ROW_BITS) + F.col("__place")).alias(name))
