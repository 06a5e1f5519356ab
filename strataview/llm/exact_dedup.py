"""Exact deduplication by tree-merging sorted digest runs.

Every partition makes a run: one entry per distinct normalised text, sorted by
digest.  Runs are then merged in binomial rounds.  A round joins ``2**bits`` runs
and at the same time halves the digest range of each merged run ``bits`` times
(recursive halving), so that a task always holds about as many entries as one
first run and no level, the last included, gathers the corpus in one place.  At each level
equal digests are merged: counts add up, the best row wins, and the second digest
and the length are compared, so that a collision is found and never merged.

Defined cases: a null text is an empty one, and empty texts are equal to each
other; rows that repeat both id and text are one document (same ``keep_id``, all
``kept``, each counted in ``group_size``); a null id loses against any id and is kept
only if its text occurs under no other id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import join_groups, stage

#: Runs that one round merges, as a power of two.
ROUND_BITS = 3

ENTRY = "digest string, check_digest long, size long, keep_chars long, keep_id long, n long"


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def merge_entries(entries: pd.DataFrame) -> pd.DataFrame:
    """Merge runs of entries: equal digests become one, the best row stays."""
    # mergesort is adaptive: concatenated sorted runs are merged, not sorted again
    entries = entries.sort_values("digest", kind="mergesort", ignore_index=True)
    best = entries.sort_values(["digest", "keep_chars", "keep_id"], ascending=[True, False, True], na_position="last", kind="mergesort")
    groups = entries.groupby("digest", sort=True)
    checked = groups[["check_digest", "size"]].nunique()
    if (checked > 1).any().any():
        raise ValueError("two different texts share a digest")
    out = best.drop_duplicates("digest")[["digest", "check_digest", "size", "keep_chars", "keep_id"]]
    out = out.assign(n=groups["n"].sum().to_numpy())
    return out


def _as_ids(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(keep_id=frame["keep_id"].astype("Int64"))


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run, waiting, rows = None, [], 0
    for batch in batches:
        waiting.append(_as_ids(batch))
        rows += len(batch)
        if rows >= 200_000:
            run, waiting, rows = merge_entries(pd.concat([run, *waiting] if run is not None else waiting)), [], 0
    if run is not None:
        waiting.insert(0, run)
    if waiting:
        yield merge_entries(pd.concat(waiting))


def tree_merge(entries: DataFrame, runs: int, bits: int = ROUND_BITS) -> DataFrame:
    """Merge the runs (column ``run``) of ``entries`` in binomial rounds."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        run, part = pdf["run"].iloc[0], pdf["part"].iloc[0]
        return merge_entries(_as_ids(pdf)).assign(run=run, part=part)

    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    out = entries
    for level in range(1, max(1, math.ceil(math.log2(max(runs, 2)) / bits)) + 1):
        range_bits = min(level * bits, 31)
        out = (
            out.withColumn("run", F.shiftright("run", bits))
            .withColumn("part", F.shiftright(prefix, 32 - range_bits))
            .groupBy("part", "run")
            .applyInPandas(merged, ENTRY + ", run long, part long")
        )
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.
    """
    text = normalised(F.col(text_col))
    rows = stage(
        docs.select(F.col(id_col).cast("long").alias("keep_id"), text.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("keep_chars")).select(
            "keep_id", "keep_chars", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("check_digest"), F.length("norm").cast("long").alias("size")
        ),
        "digests",
    )
    runs = max(1, rows.rdd.getNumPartitions())
    first = rows.withColumn("n", F.lit(1).cast("long")).select("digest", "check_digest", "size", "keep_chars", "keep_id", "n")
    first = first.mapInPandas(_run, ENTRY).withColumn("run", F.spark_partition_id().cast("long"))
    winners = stage(tree_merge(first, runs).select("digest", "keep_id", F.col("n").alias("group_size")), "winners")
    rows = rows.select(F.col("keep_id").alias("doc_id"), "digest")
    out = join_groups(rows, winners.where("group_size > 1"), "digest", "group_size", rows.count())
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
