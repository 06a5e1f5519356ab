"""Blocks by bytes, also where rows are ordered by length."""

from pyspark.sql import functions as F

from strataview.llm import ngram_lm as lm


def blocks(spark, path, block_bytes):
    rows, total = lm._in_blocks(lm._with_place(spark.read.parquet(path), "doc_id", "text"), block_bytes)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return rows.groupBy("block").agg(F.sum(size).alias("size"), F.max(size).alias("most"), F.count("*").alias("n")).collect(), total


def test_blocks_of_a_table_ordered_by_length(spark, tmp_path):
    path = str(tmp_path / "ordered")
    text = F.when(F.col("id") < 3000, F.lit("x")).when(F.col("id") < 3090, F.repeat(F.lit("word "), 600)).when(F.col("id") == 3095, F.repeat(F.lit("long "), 9000))
    spark.range(3100).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1).write.parquet(path)
    got, total = blocks(spark, path, 20_000)
    assert sum(b["n"] for b in got) == 3100 and sum(b["size"] for b in got) == total == 3000 + 90 * 3000 + 45_000
    assert all(b["size"] <= max(2 * 20_000, 20_000 + b["most"]) for b in got)
    assert len(got) < 40


def test_even_rows_are_not_cut(spark, tmp_path):
    path = str(tmp_path / "even")
    spark.range(4096).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).coalesce(1).write.parquet(path)
    got, _ = blocks(spark, path, 5120)
    assert sorted(b["n"] for b in got) == [512] * 8
    spark.range(0).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "none"))
    assert blocks(spark, str(tmp_path / "none"), 5120) == ([], 0)
