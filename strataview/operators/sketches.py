"""Cardinality sketch registers and bottom-k distinct samples over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["path", "class"]


def register_index(h: Column, b: int) -> Column:
    return F.shiftright(h, 32 - b)


def register_rank(h: Column, b: int) -> Column:
    """Leading zeros of the hash's low bits, plus one."""
    width = 32 - b
    low = h.bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    for by in (1, 2, 4, 8, 16):  # all bits below the first one are set, then counted: no texts are made
        low = low.bitwiseOR(F.shiftright(low, by))
    return (F.lit(width + 1) - F.bit_count(low)).cast("int")


def alpha(b: int) -> float:
    """Bias constants of the estimator (fixed values)."""
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(b, 0.7213 / (1 + 1.079 / (1 << b)))


def error_estimate(b: int) -> float:
    return 1.04 / (1 << b) ** 0.5


def registers(facts: DataFrame, b: int) -> DataFrame:
    """Registers (path, class, idx, rank) of all nodes."""
    return facts.where("h is not null").groupBy(*NODE, register_index(F.col("h"), b).cast("int").alias("idx")).agg(F.max(register_rank(F.col("h"), b)).alias("rank"))


def merge_registers(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*NODE, "idx").agg(F.max("rank").alias("rank"))


def estimates(regs: DataFrame, b: int) -> DataFrame:
    """Estimated distinct values per node, with the small and large range corrections."""
    if not 4 <= b <= 16:
        raise ValueError("b must be in 4..16")
    m = 1 << b
    per_node = regs.groupBy(*NODE).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("filled"))
    zeros = F.lit(m) - F.col("filled")
    raw = F.lit(alpha(b) * m * m) / (F.col("s") + zeros)
    small = F.when(zeros > 0, m * F.log(F.lit(float(m)) / zeros)).otherwise(raw)
    two32 = float(1 << 32)
    large = -two32 * F.log(1 - raw / two32)
    return per_node.select(*NODE, F.when(raw <= 2.5 * m, small).when(raw <= two32 / 30, raw).otherwise(large).alias("estimate"))


def bottom_k(counted: DataFrame, k: int | None) -> DataFrame:
    """Of (node, vtext, h, n): the k values of least hash, ties by text; None keeps all."""
    if k is None:
        return counted
    order = Window.partitionBy(*NODE).orderBy("h", "vtext")
    return counted.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")


def sample(facts: DataFrame, k: int | None, expected: DataFrame | None = None) -> DataFrame:
    """Distinct samples with exact counts: (path, class, vtext, h, n).

    ``expected`` (path, class, estimate) allows to pass on only hashes below the level
    that about 4 k values lie under, so that a column's distinct values are not shuffled.  A node
    for which that was too few is done again without the level: the result is exact.
    """
    values = facts.where("h is not null")
    keys = [*NODE, "vtext", "h"]
    if k is None or expected is None:
        return bottom_k(values.groupBy(*keys).agg(F.count("*").alias("n")), k)
    top = float(1 << 32)
    level = F.when(F.col("estimate") <= 8.0 * k, F.lit(top)).otherwise(F.lit(top) * 6 * k / F.col("estimate"))
    levels = F.broadcast(expected.select(*NODE, level.alias("__level")))  # one row a node
    below = values.join(levels, NODE).where("h < __level").groupBy(*keys).agg(F.count("*").alias("n"))
    picked = bottom_k(below, k)
    got = picked.groupBy(*NODE).agg(F.count("*").alias("__c"))
    short = expected.select(*NODE, level.alias("__l")).where(F.col("__l") < top).join(got, NODE, "left").where(F.coalesce("__c", F.lit(0)) < k).select(*NODE)
    if short.limit(1).count() == 0:
        return picked
    again = bottom_k(values.join(F.broadcast(short), NODE, "left_semi").groupBy(*keys).agg(F.count("*").alias("n")), k)
    return picked.join(F.broadcast(short), NODE, "left_anti").unionByName(again)


def merge_samples(parts: DataFrame, k: int | None, extra=()) -> DataFrame:
    """Merge samples taken with the same k: counts add up, then bottom-k again."""
    merged = parts.groupBy(*NODE, "vtext", "h").agg(F.sum("n").alias("n"), *extra)
    return bottom_k(merged, k)


def clamp_cardinality(estimate: Column, samples: Column, count: Column) -> Column:
    """The rounded estimate, not below the distinct samples nor above the count."""
    return F.least(F.greatest(F.floor(estimate + 0.5), samples), count).cast("long")
