"""Append-only logs of framed records, read in byte ranges and in spite of damage.

A frame is ``MARK``, a kind (``H`` for the header, ``R`` for a record), the length and the crc32 of its content in eight hexadecimal digits
each, the content (JSON, which holds no control character) and a line feed.  Files are read by Spark's text reader with ``MARK`` as the
separator, so a file of any size is divided into byte ranges by Spark, on any file system, and after damage
reading goes on at the next mark.  What stands between two marks is a chunk: it gives a record if the length and the crc agree; what
follows the record's end, or the whole chunk otherwise, is skipped and counted.

A header frame stands in a file's first chunk and is no record.  A file without any whole frame counts as a skipped file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "\x1eLOG"
HEADER, RECORD, END = "H", "R", "\n"
#: Characters of a chunk before its content, and after it.
BEFORE, AFTER = 17, 1
#: Times keep their microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def frame(kind: str, content: Column) -> Column:
    """The frame of a content, with its mark and end."""
    hexed = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
    data = content.cast("binary")
    return F.concat(F.lit(MARK + kind), hexed(F.octet_length(data).cast("long")), hexed(F.crc32(data)), content)


def write_log(records: DataFrame, path: str, header: dict | None = None, mode: str = "errorifexists", change=None) -> None:
    """Write ``records`` as log files; each begins with a frame of ``header``.  ``change`` alters frames (tests damage them by it)."""
    frames = records.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns)), JSON).alias("json"), F.monotonically_increasing_id().alias("nth"), *(F.col(f"`{c}`") for c in records.columns))
    line = frame(RECORD, F.col("json"))
    if change is not None:
        line = change(line)
    if header is not None:
        first = F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)) == 0
        line = F.when(first, F.concat(frame(HEADER, F.lit(json.dumps(header))), F.lit(END), line)).otherwise(line)
    frames.select(line.alias("value")).write.mode(mode).option("lineSep", END).text(path)


def _chunks(lines: DataFrame) -> DataFrame:
    """Chunks of files: file, kind, content (null where damaged) and skipped bytes."""
    data = F.col("value").cast("binary")
    number = lambda at: F.conv(F.substring(data, at, 8).cast("string"), 16, 10).try_cast("long")
    size, crc = number(2), number(10)
    content = F.substring(data, F.lit(BEFORE + 1), F.least(size, F.octet_length(data).cast("long")).cast("int"))
    total = F.octet_length(data).cast("long")
    kind = F.substring(data, 1, 1).cast("string")
    digits = F.substring(data, 2, 16).cast("string").rlike("^[0-9a-f]{16}$")
    whole = digits & kind.isin(HEADER, RECORD) & (size <= total - BEFORE) & (F.crc32(content) == crc)
    # a last frame that is cut off after its content has no end
    used = F.least(BEFORE + size + AFTER, total)
    rows = lines.select("value", F.col("_metadata.file_path").alias("file")).where(F.octet_length("value") > 0)
    return rows.select("file", F.when(whole, kind).alias("kind"), F.when(whole, content.cast("string")).alias("content"), F.when(whole, total - used).otherwise(total + len(MARK)).alias("skipped"))


@dataclass(frozen=True)
class Log:
    """``records`` of a log; ``report``: per file its records, skipped bytes, damaged chunks and whether it was skipped as a whole."""

    records: DataFrame
    report: DataFrame
    headers: DataFrame


def _parsed(chunks: DataFrame, schema: str | T.StructType) -> DataFrame:
    return chunks.where(F.col("kind") == RECORD).select(F.from_json("content", schema, JSON).alias("r")).select("r.*")


def read_framed(spark: SparkSession, path: str, schema: str | T.StructType) -> Log:
    """Records of the log files below ``path``, and what had to be skipped."""
    chunks = _chunks(spark.read.option("lineSep", MARK).text(path))
    report = chunks.groupBy("file").agg(
        F.count(F.when(F.col("kind") == RECORD, 1)).alias("records"), F.sum("skipped").alias("skipped_bytes"), F.count(F.when(F.col("skipped") > 0, 1)).alias("damaged"), (F.count("kind") == 0).alias("is_skipped")
    )
    headers = chunks.where(F.col("kind") == HEADER).select("file", F.col("content").alias("header"))
    return Log(_parsed(chunks, schema), report, headers)


def stream_framed(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> DataFrame:
    """Records of log files as they arrive."""
    return _parsed(_chunks(spark.readStream.option("lineSep", MARK).options(**options).text(path)), schema)
