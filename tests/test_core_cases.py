"""Values and names at the edges: improper lists, odd names, big integers, limits, soft stop, navigation."""

import time
from decimal import Decimal

from pyspark.sql import functions as F

from strataview.functions.hierarchy import path_above, step_name, type_to_string
from strataview.operators.postproc import neighbour_of, nth_child, path_parent, siblings_of, stack_of
from strataview.plans.background import Probe
from strataview.plans.profile import probe_facts, profile
from strataview.plans.render import build, collect_nodes, declaration
from strataview.sources.tables import improper_list


def counts(spec):
    return {(r["path"], r["class"]): r["n"] for r in spec.nodes.collect()}


def test_improper_list(spark):
    df = spark.createDataFrame([([1, 300], "x"), ([5], "y"), ([7], "z")], "items array<int>, tail string").select(improper_list(F.col("items"), F.col("tail")).alias("v"))
    spec = profile(df, "v", limit=None, categorical=("$[|]",))
    assert counts(spec) == {("$", "improper_list"): 3, ("$[]", "byte"): 3, ("$[]", "char"): 1, ("$[|]", "atom"): 3}
    # the histogram holds the lengths of the proper parts
    assert {(r["class"], r["bucket"], r["n"]) for r in spec.histogram.where("class = 'improper_list'").collect()} == {("improper_list", 1, 2), ("improper_list", 2, 1)}
    assert "improper_list(" in declaration(build(collect_nodes(spec.nodes)))


def test_names_with_dots_and_brackets(spark):
    df = spark.createDataFrame([(1, (2,), {"k.1": 3, "[]": 4, "a\\\\b": 5})], "`a.b` int, a struct<b: int>, m map<string,int>")
    spec = profile(df, 0, limit=None, name="r")
    names = [r"$.a\.b", "$.a.b", "$.m." + step_name("k.1"), "$.m." + step_name("[]"), "$.m." + step_name("a\\\\b")]
    assert {p for p, _ in counts(spec)} == {"$", "$.a", "$.m", *names}
    above = {r["path"]: r["up"] for r in spec.nodes.select("path", path_parent(F.col("path")).alias("up")).collect()}
    assert above == {p: path_above(p) for p in above}
    assert above[names[0]] == "$" and above[names[1]] == "$.a" and {above[n] for n in names[2:]} == {"$.m"}
    assert [r["path"] for r in stack_of(spec.nodes, names[2]).orderBy("depth").collect()] == ["$", "$.m", names[2]]


def test_integers_beyond_bigint(spark):
    df = spark.createDataFrame([(Decimal(2_000_000_000),), (Decimal(5 * 10**20),), (Decimal(-7),)], "v decimal(38,0)")
    ends = {r["which"]: r["vtext"] for r in profile(df, "v", limit=None).extremes.where("class = 'non_neg_integer'").collect()}
    assert ends == {"min": "2000000000", "max": "500000000000000000000"}
    js = spark.createDataFrame([("123456789012345678901234",), ("1.5",), ("-123456789012345678901234",)], "t string").select(F.parse_json("t").alias("v"))
    assert counts(profile(js, "v", limit=None)) == {("$", "non_neg_integer"): 1, ("$", "float"): 1, ("$", "neg_integer"): 1}


def test_limit_picks_rows_once(spark):
    df = spark.range(5000).repartition(7).withColumn("r", F.rand()).withColumn("same", F.col("r"))
    spec = profile(df, 0, limit=100, name="t", samples="all")
    assert counts(spec)["$", "#t/4"] == 100
    texts = {p: {r["vtext"] for r in spec.samples.where(F.col("path") == p).collect()} for p in ("$.r", "$.same")}
    assert texts["$.r"] == texts["$.same"] and len(texts["$.r"]) == 100
    assert {r["vtext"] for r in spec.extremes.where("path = '$.r'").collect()} <= texts["$.r"]


def test_parts_and_soft_stop(spark, tmp_path):
    df = spark.range(400).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    probe = Probe(df, 0, output_path=str(tmp_path / "whole"), parts=3, limit=None, name="t")
    spec = probe.wait()
    assert [p[:2] for p in probe.progress] == [(1, 3), (2, 3), (3, 3)]
    assert counts(spec)["$", "#t/3"] == 400 == spec.meta["processed"]
    probe = Probe(df, 0, output_path=str(tmp_path / "stopped"), parts=50, limit=None, name="t")
    while not probe.progress:
        time.sleep(0.05)
    probe.stop()
    spec = probe.wait()
    assert 0 < counts(spec)["$", "#t/3"] == spec.meta["processed"] < 400


def test_navigation_to_the_side(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "a int, b string, c double")
    nodes = profile(df, 0, limit=None, name="t").nodes
    paths = lambda found: sorted(r["path"] for r in found.collect())
    assert paths(siblings_of(nodes, "$.b")) == ["$.a", "$.b", "$.c"]
    assert paths(neighbour_of(nodes, "$.b", -1)) == ["$.a"] and paths(neighbour_of(nodes, "$.b", 1)) == ["$.c"] and paths(neighbour_of(nodes, "$.c", 1)) == []
    assert paths(nth_child(nodes, "$", 2)) == ["$.b"] and paths(siblings_of(nodes, "$")) == ["$"]


def test_display_names():
    assert [type_to_string(n) for n in ("#row/3", "tuple/2", "nonempty_list", "<<>>", "[]", "0")] == ["#row/3", "tuple/2", "nonempty_list", "'<<>>'", "'[]'", "0"]


def test_facts_of_null_improper_list(spark):
    df = spark.createDataFrame([(None, None)], "items array<int>, tail string").select(F.when(F.lit(False), improper_list(F.col("items"), F.col("tail"))).alias("v"))
    assert [(r["path"], r["class"]) for r in probe_facts(df, "v").collect()] == [("$", "null")]
