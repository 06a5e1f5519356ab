"""Connected components by alternating large-star and small-star steps.

Edges are first contracted to forests within tasks, as they come and dealt by either end (an end of
very many edges over ``SALTS`` tasks), so few rounds are left.  Once no more than ``CONTRACTED`` edges are
left, as many as any task contracts at once, one task does the rest; the rounds, each of a dozen
stages that the driver plans and keeps records of, are for more.  Each step of a round is a grouped minimum and
a join over the edge table, in which keys of very many edges are joined by broadcast (``join_groups``);
more edges than that are never gathered in one task, and none on the driver; the edges are staged after
every round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import join_groups, release, stage
from strataview.llm.textkit import thrifty

#: Edges that a task contracts at once.
CONTRACTED = 2_000_000
SALTS = 8


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, least number of its component) of those of 0..n-1 that are not the least themselves."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            break
        low = new
    other = np.flatnonzero(low != np.arange(n))
    return other, low[other]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def contracted(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        names, back = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        x, y = forest(len(names), *np.split(back, 2))
        return pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], ["a", "b"])

    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > CONTRACTED:
            yield contracted(a, b)
            a, b = [], []
    if a:
        yield contracted(a, b)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(pairs: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Pairs (u, v) become (v, least of u's neighbourhood)."""
    return join_groups(pairs, low, "u", "times", total).select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = CONTRACTED) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, not null); component is the least node.

    ``at_once`` edges, ``CONTRACTED`` at most, are left to one task.  Raises if the labels have not settled after ``max_rounds``.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(thrifty(_contract), "a long, b long")
    for end, other in ("ba", "ab"):
        edges = edges.repartition(end, F.pmod(F.xxhash64(other), F.lit(SALTS))).mapInArrow(thrifty(_contract), "a long, b long")
    edges = stage(edges.distinct(), "edges")
    before = _signature(edges)
    for _ in range(max_rounds):
        if before[0] <= min(at_once, CONTRACTED):
            if before[0]:
                old, edges = edges, stage(edges.coalesce(1).mapInArrow(thrifty(_contract), "a long, b long"), "edges")
                release(old)
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("times"))
        large = _star(both.where("v > u"), low, 2 * before[0]).unionByName(low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = _star(down, low, before[0]).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, stage(small.distinct(), "edges")
        release(old)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
