"""Training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents.  The first four return the
columns of their input.  Every row is judged by itself: rows without id, and rows that share an id but not a
text, stand for documents of their own, as stages tell rows apart by their place in the files.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataview.llm.decontaminate import find_contamination
from strataview.llm.exact_dedup import exact_dedup, normalised
from strataview.llm.jaccard_join import jaccard_join
from strataview.llm.mixing import mix_sources
from strataview.llm.staging import drop_rows, keep_rows, numbered, read_documents, small_batches, stage
from strataview.llm.toxicity import keep_clean

ROW = "__row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold."""
    small_batches(spark)
    return keep_clean(docs, read_documents(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the longest original, then the smallest id."""
    small_batches(spark)
    judged = stage(exact_dedup(docs), "exact")
    keys = {"doc_id": F.col("doc_id").cast("long"), "text_sha256": F.sha2(normalised(F.col("text")), 256)}
    repeated = judged.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    out = drop_rows(docs, judged.where("not kept"), keys)
    if repeated.limit(1).count() == 0:
        return out
    # rows that repeat an id and its text: the longest original of them stays
    once = Window.partitionBy(*keys.values()).orderBy(F.length("text").desc_nulls_last(), "text")
    return out.withColumn("__nth", F.row_number().over(once)).where("__nth = 1").drop("__nth")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` without the numbers in ``dropped``, and without their own."""
    return drop_rows(rows, dropped.select(ROW), {ROW: F.col(ROW)}).drop(ROW)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; one without id only if none has any.

    Of rows that repeat an id the one that comes first in the files.  Documents without words are no copies and stay.
    """
    small_batches(spark)
    rows = numbered(docs, ROW)
    joined = jaccard_join(rows, id_col=ROW)
    linked = stage(joined.where("component_id <> doc_id").select(F.col("doc_id").alias(ROW), "component_id"), "linked")
    members = linked.unionByName(linked.select(F.col("component_id").alias(ROW), "component_id").distinct())
    ids = keep_rows(rows.select(ROW, F.col("doc_id").cast("long").alias("id")), members, ROW, F.col(ROW))
    members = stage(members.join(ids, ROW), "members")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first"))
    return without(rows, members.select(ROW).join(stays.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every row is judged by its own text."""
    small_batches(spark)
    rows = numbered(docs, ROW)
    hits = find_contamination(rows, read_documents(spark, sf_dir, "benchmark"), id_col=ROW)
    return without(rows, hits.select(F.col("doc_id").alias(ROW)))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that their tokens meet the source, language and topic targets; rows without id are drawn by their texts."""
    small_batches(spark)
    rows = numbered(docs, ROW)
    return without(rows, mix_sources(rows, keep=(ROW,), topics_by="words").where("not kept"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", sample_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
