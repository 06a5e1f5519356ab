"""Merging and rolling up the tables of a spec.

A spec's tables are keyed by (path, class, ...), so merging is a union and the same
aggregation again.  Order of parts never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataview.operators.sketches import NODE, bottom_k

#: Columns of a (ts, key) span.
SPAN = ["first_ts", "first_key", "last_ts", "last_key"]


def first_of(ts: str | Column, key: str | Column) -> Column:
    """min of (ts, key), missing ts only if there is no other."""
    ts, key = (F.col(x) if isinstance(x, str) else x for x in (ts, key))
    pair = F.struct(ts.alias("ts"), key.alias("key"))
    return F.coalesce(F.min(F.when(ts.isNotNull(), pair)), F.min(F.when(ts.isNull() & key.isNotNull(), pair)))


def last_of(ts: str | Column, key: str | Column) -> Column:
    ts, key = (F.col(x) if isinstance(x, str) else x for x in (ts, key))
    pair = F.struct(ts.alias("ts"), key.alias("key"))
    return F.coalesce(F.max(F.when(ts.isNotNull(), pair)), F.max(F.when(ts.isNull() & key.isNotNull(), pair)))


def with_span(df: DataFrame) -> DataFrame:
    """Spread the structs __first and __last to the span columns."""
    rest = [c for c in df.columns if not c.startswith("__")]
    return df.select(*rest, F.col("__first.ts").alias("first_ts"), F.col("__first.key").alias("first_key"), F.col("__last.ts").alias("last_ts"), F.col("__last.key").alias("last_key"))


def merge_spans(parts: DataFrame, *keys: str) -> DataFrame:
    """Per-value attributes: counts add up, spans widen."""
    merged = parts.groupBy(*keys).agg(F.sum("n").alias("n"), first_of("first_ts", "first_key").alias("__first"), last_of("last_ts", "last_key").alias("__last"))
    return with_span(merged)


def merge_nodes(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*NODE).agg(F.sum("n").alias("n"))


def merge_extremes(parts: DataFrame) -> DataFrame:
    """Keep the smallest and largest values of each node; equal ones join their counts and spans.

    Values are ordered by rank of kind and the binary key ``ord``; numbers compare by value whatever their type.
    """
    order = Window.partitionBy(*NODE, "which")
    mins = parts.where("which = 'min'").withColumn("__r", F.rank().over(order.orderBy("rank", "ord")))
    maxs = parts.where("which = 'max'").withColumn("__r", F.rank().over(order.orderBy(F.desc("rank"), F.desc("ord"))))
    best = mins.unionByName(maxs).where(F.col("__r") == 1)
    merged = best.groupBy(*NODE, "which", "rank", "ord").agg(
        F.max("inum").alias("inum"), F.max("num").alias("num"), F.min("vtext").alias("vtext"), F.sum("n").alias("n"), first_of("first_ts", "first_key").alias("__first"), last_of("last_ts", "last_key").alias("__last")
    )
    return with_span(merged.select(*NODE, "which", "rank", "ord", "inum", "num", "vtext", "n", "__first", "__last"))


def merge_sample_table(parts: DataFrame, k: int | None) -> DataFrame:
    merged = parts.groupBy(*NODE, "vtext", "h").agg(F.sum("n").alias("n"), first_of("first_ts", "first_key").alias("__first"), last_of("last_ts", "last_key").alias("__last"))
    return with_span(bottom_k(merged, k))


def merge_histogram(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*NODE, "bucket").agg(F.sum("n").alias("n"))


def merge_dictionary(parts: DataFrame) -> DataFrame:
    return merge_spans(parts, *NODE, "vtext")
