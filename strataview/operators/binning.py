"""Equal-width binning of a histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Report width, and what a bar and the margins take of it (fixed values).
WIDTH, MARGIN, BAR = 600, 100, 30


def bin_count(width: int = WIDTH) -> int:
    return max(1, (width - MARGIN) // BAR)


def bin_histogram(hist: DataFrame, bins: int, value: str = "bucket", count: str = "n") -> DataFrame:
    """(mid, n) of ``bins`` equal bins, the last one closed; empty bins have 0.

    A histogram of no more than ``bins`` values is returned as it is.
    """
    ends = hist.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("values"))
    raw = hist.crossJoin(F.broadcast(ends)).where(F.col("values") <= bins).select(F.col(value).cast("double").alias("mid"), F.col(count).cast("long").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    placed = hist.crossJoin(F.broadcast(ends)).where(F.col("values") > bins)
    number = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(number.alias("bin")).agg(F.sum(count).alias("n"))
    every = ends.where(F.col("values") > bins).select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.col("lo") + width * F.col("bin")
    high = F.when(F.col("bin") == bins - 1, F.col("hi").cast("double")).otherwise(F.col("lo") + width * (F.col("bin") + 1))
    binned = every.join(F.broadcast(counts), "bin", "left").select(((low + high) / 2).alias("mid"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return raw.unionByName(binned)


def bin_number(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((v - lo) / ((hi - lo) / F.lit(float(bins)))), F.lit(bins - 1)).cast("int")
