"""Files of several schemas as one table, and background parts that are files."""

import os

import pytest
from pyspark.sql import functions as F

from strataview.plans.background import deal
from strataview.plans.profile import profile, profile_variants
from strataview.plans.render import build, collect_nodes, declaration
from strataview.plans.spec import RawSpec
from strataview.sources.variants import file_variants, read_variants


def nodes(spec):
    return {(r["path"], r["class"]): r["n"] for r in spec.nodes.collect()}


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(30).select("id", F.lit("x").alias("b"), F.struct(F.lit(1).alias("u")).alias("at")).repartition(2).write.parquet(path)
    spark.range(20).select("id", F.lit("y").alias("b"), F.struct(F.lit(1).alias("u"), F.lit(2).alias("v")).alias("at"), F.lit(0.5).alias("c")).write.mode("append").parquet(path)
    spark.range(10).select("id", F.lit(True).alias("d"), F.struct(F.lit("t").alias("w")).alias("at")).write.mode("append").parquet(path)
    spark.range(0).select("id", F.lit(None).cast("date").alias("e")).write.mode("append").parquet(path)
    return path


def test_each_schema_is_found_once(spark, folder):
    found = file_variants(spark, folder)
    assert sorted(v.schema.names for v in found) == [["id", "b", "at"], ["id", "b", "at", "c"], ["id", "d", "at"], ["id", "e"]]
    files = [f for v in found for f in v.files]
    assert len(files) == len(set(files)) and set(files) == set(spark.read.parquet(folder).inputFiles())
    assert sum(df.count() for df in read_variants(spark, folder)) == 60
    with pytest.raises(ValueError, match="more than 2 schemas"):
        file_variants(spark, folder, most=2)


def test_records_of_each_schema_are_nodes(spark, folder, tmp_path):
    spec = profile_variants(read_variants(spark, folder), limit=None, name="rec", output_path=str(tmp_path / "spec"))
    spec = RawSpec.load(spark, str(tmp_path / "spec"))
    got = nodes(spec)
    assert got["$", "#rec/4"] == 40 and got["$", "#rec/5"] == 20 and ("$", "#rec/3") not in got and spec.meta["processed"] == 60
    assert got["$.at", "#at/2"] == 40 and got["$.at", "#at/3"] == 20
    assert got["$.b", "binary"] == 50 and got["$.d", "boolean"] == 10 and got["$.c", "float"] == 20 and not any(p == "$.e" for p, _ in got)
    lists = {(p, c): sorted(n for q, d, n in spec.meta["records"] if (p, c) == (q, d)) for p, c, _ in spec.meta["records"]}
    assert lists["$", "#rec/4"] == [["id", "b", "at"], ["id", "d", "at"]] and lists["$", "#rec/5"] == [["id", "b", "at", "c"]]
    assert lists["$.at", "#at/2"] == [["u"], ["w"]] and lists["$.at", "#at/3"] == [["u", "v"]]
    view = spec.postproc()
    text = declaration(build(collect_nodes(view.nodes), fields=view.meta["fields"], records=view.meta["records"]))
    assert text.count("#rec{") == 3
    wide = next(line for line in text.splitlines() if " c :: " in line)
    assert " d :: " not in wide and " b :: " in wide
    assert any(" d :: boolean()" in line and " b :: " not in line for line in text.splitlines())


def test_whole_equals_profile_where_there_is_one_schema(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).select("id", (F.col("id") % 3).alias("r"), F.when(F.col("id") > 5, "t").alias("s")).repartition(5).write.partitionBy("r").parquet(path)
    one = profile(spark.read.parquet(path), 0, limit=None, name="t")
    variants = read_variants(spark, path)
    assert len(variants) == 1 and variants[0].columns == ["id", "s", "r"]
    many = profile_variants(variants, limit=None, name="t")
    assert nodes(one) == nodes(many) and one.meta["records"] == many.meta["records"] == [["$", "#t/4", ["id", "s", "r"]]]
    assert sorted(map(str, one.samples.collect())) == sorted(map(str, many.samples.collect()))


def test_limit_probe_and_merge_over_schemas(spark, folder):
    variants = read_variants(spark, folder)
    assert sum(n for (p, _), n in nodes(profile_variants(variants, limit=35, name="r")).items() if p == "$") == 35
    assert nodes(profile_variants(variants, "d", limit=None)) == {("$", "boolean"): 10}
    first, second = (profile(df, 0, limit=None, name="r") for df in sorted(variants, key=lambda d: d.columns)[:2])
    merged = first.merge(second)
    assert merged.meta["records"] == [*first.meta["records"], *(r for r in second.meta["records"] if r not in first.meta["records"])]
    with pytest.raises(ValueError, match="no records"):
        profile_variants([])


def test_parts_by_file_read_their_own_files_alone(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(500).repartition(24).write.parquet(path)
    df = spark.read.parquet(path)
    parts = deal(df, 3)
    files = [{r["f"] for r in p.select(F.col("_metadata.file_path").alias("f")).distinct().collect()} for p in parts]
    assert sum(map(len, files)) == 24 == len(set.union(*files)) and sorted(r["id"] for p in parts for r in p.collect()) == list(range(500))
    # a part can be read although the files of another are gone
    before = parts[0].count()
    for name in files[1]:
        os.remove(name.removeprefix("file:"))
    assert parts[0].count() == before


def test_parts_of_other_rows_go_by_hash(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(200).repartition(12).write.parquet(path)
    df = spark.read.parquet(path)
    grouped = df.groupBy((F.col("id") % 50).alias("k")).count()
    both = df.union(df)
    cached = df.where("id < 100").persist()
    for rows, n in ((grouped, 50), (both, 400), (cached, 100), (df, 200)):
        assert sum(p.count() for p in deal(rows, 3)) == n
    cached.unpersist()
