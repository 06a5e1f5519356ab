"""Sources: any table, file or view as records to explore."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataview.functions.hierarchy import IMPROPER
from pyspark.sql import types as T

FILE_FORMATS = ("parquet", "orc", "csv", "json", "text", "avro", "xml")
CORRUPT = "_corrupt_record"


def open_source(spark: SparkSession, kind: str, name: str, tolerant: bool = False, **options) -> DataFrame:
    """Records of a source: a ``view`` or ``table`` by name, ``jdbc``, a ``log`` of JSON lines, or files of a format.

    ``tolerant`` skips damaged files and keeps damaged lines apart (see ``split_corrupt``).
    """
    if kind in ("view", "table"):
        return spark.table(name)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    if kind == "log":
        return spark.read.options(**options).text(name).select(F.col("value").alias("line"), F.try_parse_json("value").alias("record"))
    if kind not in FILE_FORMATS:
        raise ValueError(f"unknown kind of source {kind!r}")
    reader = spark.read.options(**options)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", True)
        if kind in ("csv", "json"):
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.format(kind).load(name)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's ``spark.checkpoint.dir``; a private one on a local master alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return "file://" + tempfile.mkdtemp(prefix="strataview-")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan whose rows lie in at least as many partitions as tasks can run; only inputs of few splits are dealt anew.

    Where there are fewer than two splits a core, Spark has cut files into as many pieces as cores, and a piece without the middle of a
    row group is empty, so the number of splits says nothing of the rows in each.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan.repartition(cores if splits < cores else 2 * cores) if splits < 2 * cores else scan


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes from now on, unless the session has a lower bound; whole texts come in batches of 10,000 otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, header: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """An append-only log of JSON lines: (records, number of damaged lines); ``header`` rows are skipped."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    good, bad = split_corrupt(rows)
    return (good.where(~header) if header is not None else good), bad.agg(F.count("*").alias("skipped"))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that could be read, and those that could not."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def default_table(spark: SparkSession) -> str | None:
    """The first table by name."""
    return next(iter(list_tables(spark)), None)


def validate(spark: SparkSession, kind: str, name: str) -> str | None:
    """What is wrong with a source, or None."""
    try:
        schema = open_source(spark, kind, name).schema
    except Exception as error:  # noqa: BLE001  any failure to open is the answer
        return str(error).splitlines()[0]
    return None if schema.fields else f"{name} has no columns"


def from_values(spark: SparkSession, values: list, schema: str = "value string") -> DataFrame:
    """Records of the caller's own values."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    return spark.createDataFrame(rows, schema)


def improper_list(items: Column, tail: Column) -> Column:
    """A list with a tail of another kind; flattening tells it from records by its field names."""
    return F.struct(items.alias(IMPROPER[0]), tail.alias(IMPROPER[1]))
