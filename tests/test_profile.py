import random

import pytest
from pyspark.sql import functions as F

from strataview.operators.binning import bin_count, bin_histogram
from strataview.operators.sketches import error_estimate, estimates, merge_registers, registers, sample
from strataview.plans.background import Probe
from strataview.plans.options import make_options
from strataview.plans.plots import csv_lines, histogram_script, tick, timeline_script
from strataview.plans.profile import cardinalities, probe_facts, profile
from strataview.plans.render import build, collect_nodes, ddl, declaration
from strataview.plans.report import ReportConfig, report_page
from strataview.plans.spec import RawSpec, View
from strataview.sources.tables import from_values, list_tables, open_source, read_log, validate
from strataview.streaming.incremental import IncrementalSpec

ALL = make_options(limit=None)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def records(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = [
        (k, rng.choice([None, 0, 7, 300, -4, 2_000_000]), rng.choice(["", "a", "bb", None]), [float(x) for x in range(rng.randint(0, 4))], {f"k{j}": j for j in range(rng.randint(0, 3))}, (rng.random() < 0.5, rng.choice([1.5, None])), rng.choice(['{"a": 1}', '{"a": "x", "b": [1, "y"]}', "[1, 2.5]", "bad", "null"]), k % 50)
        for k in range(n)
    ]
    df = spark.createDataFrame(data, "id long, num int, txt string, arr array<double>, m map<string,int>, st struct<f: boolean, g: double>, js string, t long")
    return df.withColumn("js", F.try_parse_json("js"))


PROBE = (0, {"ts": "t", "key": "id"})


def test_merge_of_parts_is_the_whole(spark):
    df = records(spark).cache()
    opts = dict(limit=None, name="rec", categorical=("$.txt",))
    whole = profile(df, PROBE, **opts).persist()
    a, b, c = (profile(df.where(F.col("id") % 3 == k), PROBE, **opts).persist() for k in range(3))
    one, two = a.merge(b, c).persist(), c.merge(a.merge(b))
    for table in ("nodes", "registers", "samples", "dictionary", "histogram"):
        columns = getattr(whole, table).columns
        want = rows(getattr(whole, table))
        assert rows(getattr(one, table).select(*columns)) == want == rows(getattr(two, table).select(*columns)), table
    columns = ["path", "class", "which", "vtext", "n", "first_ts", "first_key", "last_ts", "last_key"]
    assert rows(one.extremes.select(*columns)) == rows(whole.extremes.select(*columns))
    card = cardinalities(whole).join(whole.samples.groupBy("path", "class").agg(F.count("*").alias("s")), ["path", "class"]).collect()
    assert all(r["s"] <= r["cardinality"] <= r["n"] for r in card)
    with pytest.raises(ValueError):
        a.merge(profile(df, PROBE, limit=None, samples=4, name="rec"))


def test_tree_of_a_nested_record(spark):
    df = records(spark)
    spec = profile(df, 0, limit=None, name="rec")
    n = {(r["path"], r["class"]): r["n"] for r in spec.nodes.collect()}
    assert n["$", "#rec/9"] == 300
    assert sum(v for (p, _), v in n.items() if p == "$.num") == 300
    assert n["$.arr", "nonempty_list"] + n["$.arr", "[]"] == 300
    assert n["$.arr[]", "float"] == df.select(F.sum(F.size("arr"))).first()[0]
    assert n["$.m", "map"] == 300 and n["$.m.k0", "0"] >= n["$.m.k1", "byte"] >= n["$.m.k2", "byte"]
    assert n["$.st", "#st/3"] == n["$.st.f", "boolean"] == 300
    assert n["$.js", "null"] > 0 and n["$.js", "map"] + n["$.js", "nonempty_list"] + n["$.js", "null"] == 300
    assert n["$.js.b[]", "byte"] == n["$.js.b[]", "binary"] == n["$.js.a", "binary"]
    hist = {(r["path"], r["bucket"]): r["n"] for r in spec.histogram.collect()}
    assert hist["$.txt", 0] == n["$.txt", "<<>>"] and hist["$.txt", 8] + hist["$.txt", 16] == n["$.txt", "binary"]
    view = spec.postproc()
    v = {(r["path"], r["class"]): r["n"] for r in view.nodes.collect()}
    assert v["$.num", "integer"] == sum(x for (p, c), x in n.items() if p == "$.num" and c != "null")
    assert v["$.num", "term"] == 300 and ("$.num", "number") not in v
    assert v["$.txt", "binary"] == n["$.txt", "binary"] + n["$.txt", "<<>>"]
    assert ("$.arr[]", "number") not in v and ("$", "tuple") not in v
    text = declaration(build(collect_nodes(view.nodes), fields=view.meta["fields"]))
    assert text.startswith("#rec{id :: char(), num :: integer() | null(), txt :: ") and "arr :: [float()] | []" in text
    assert ddl(build(collect_nodes(view.nodes), "$.arr")) == "ARRAY<DOUBLE>"
    assert ddl(build(collect_nodes(view.nodes), "$.st")) == "STRUCT<f: BOOLEAN, g: DOUBLE>"
    page = report_page(view, "$.txt", "binary", ReportConfig(sort={"samples": (2, "descending")}))
    assert "Histogram" in page and "&lt;" not in page.split("Samples")[0][:50]


def test_field_probe_equals_the_child_of_the_whole(spark):
    df = records(spark)
    whole = profile(df, PROBE, limit=None, name="rec")
    for field in ("num", "txt"):
        part = profile(df, (field, PROBE[1]), limit=None)
        for table in ("nodes", "samples", "extremes", "histogram"):
            mine = getattr(part, table)
            child = getattr(whole, table).where(F.col("path") == f"$.{field}").withColumn("path", F.lit("$"))
            assert rows(mine.where("path = '$'").select(*mine.columns)) == rows(child.select(*mine.columns)), (field, table)


def test_map_key_union(spark):
    maps = [{"k1": 1, "k2": 2, "k3": 3, "k4": 4}, {"k2": 1, "k4": 2}, {"k1": 1, "k4": 1, "k2": 0}, {"k2": 3}, {"k1": 5, "k3": 1}]
    spec = profile(spark.createDataFrame([(m,) for m in maps], "m map<string,int>"), "m", limit=None)
    counts = {r["path"]: r["n"] for r in spec.nodes.groupBy("path").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"$": 5, "$.k1": 3, "$.k2": 4, "$.k3": 2, "$.k4": 3}


def test_selectors(spark):
    df = spark.createDataFrame([(1, (2, "x"), [5, 6], '{"a": {"b": 3}}'), (2, None, [], "no json")], "a int, s struct<p:int,q:string>, l array<int>, j string")

    def values(selector):
        return [r["vtext"] for r in probe_facts(df, selector, ALL).where("path = '$' and class not like '#%'").orderBy("vtext").select("vtext").collect()]

    assert values(2) == values("a") == ["1", "2"]
    assert values([3, 2]) == values("s.p") == values(["s", "p"]) == ["2"]
    assert values(["l", 2]) == ["6"]
    assert values(["j", "a", "b"]) == ["3"]
    assert values(lambda r: F.when(r["a"] > 1, r["a"])) == ["2"]
    assert values("nothing") == values(99) == []
    assert probe_facts(df, 0, ALL).where("path = '$'").count() == probe_facts(df, [], ALL).where("path = '$'").count() == 2
    assert probe_facts(df, 0, make_options(limit=1)).where("path = '$'").count() == 1


def test_sketch_bounds(spark):
    values = spark.range(10_000).select(F.lit("$").alias("path"), F.lit("x").alias("class"), F.col("id").cast("string").alias("vtext"))
    hashed = values.withColumn("h", F.xxhash64("vtext").bitwiseAND(F.lit(0xFFFFFFFF)))
    est = estimates(registers(hashed, 9), 9).first()["estimate"]
    assert abs(est - 10_000) / 10_000 < 3 * error_estimate(9)
    both = merge_registers(registers(hashed.where("vtext < '5'"), 9).unionByName(registers(hashed.where("vtext >= '3'"), 9)))
    assert estimates(both, 9).first()["estimate"] == est
    with pytest.raises(ValueError):
        estimates(both, 3)


def test_level_never_changes_a_sample(spark):
    df = spark.range(30_000).select(F.lit("$").alias("path"), F.lit("x").alias("class"), (F.col("id") % 9000).cast("string").alias("vtext"))
    df = df.withColumn("h", F.xxhash64("vtext").bitwiseAND(F.lit(0xFFFFFFFF)))
    plain = rows(sample(df, 16).select("vtext", "n"))
    for guess in (9000.0, 100.0, 1e9):
        expected = spark.createDataFrame([("$", "x", guess)], "path string, class string, estimate double")
        assert rows(sample(df, 16, expected).select("vtext", "n")) == plain
    assert len(plain) == 16 and {n for _, n in plain} <= {3, 4}


def test_binning(spark):
    data = [(1, 6481), (3, 862931), (4, 5109), (5, 59340), (6, 32026), (7, 54689), (8, 137813), (11, 53553)]
    hist = spark.createDataFrame(data, "bucket long, n long")
    assert rows(bin_histogram(hist, 1)) == [(6.0, 1211942)]
    assert rows(bin_histogram(hist, 2)) == [(3.5, 933861), (8.5, 278081)]
    assert rows(bin_histogram(hist, 4)) == [(2.25, 869412), (4.75, 64449), (7.25, 224528), (9.75, 53553)]
    assert len(rows(bin_histogram(hist, 8))) == 8 and bin_count() == 16


def test_save_load_stream_and_background(spark, tmp_path):
    df = records(spark, 200)
    spec = profile(df, PROBE, limit=None, name="rec", output_path=f"{tmp_path}/a")
    back = RawSpec.load(spark, f"{tmp_path}/a")
    assert rows(back.nodes) == rows(spec.nodes) and back.meta["processed"] == 200
    back.postproc().save(f"{tmp_path}/v")
    assert isinstance(View.load(spark, f"{tmp_path}/v"), View) and not hasattr(View, "postproc")
    flat = df.select("id", "num", "t")
    for k in range(3):
        flat.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    grown = IncrementalSpec(spark, f"{tmp_path}/s", PROBE, name="rec")
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    grown.start(stream, f"{tmp_path}/c").awaitTermination()
    whole = profile(flat, PROBE, limit=None, name="rec")
    assert rows(grown.current().nodes) == rows(whole.nodes)
    assert rows(grown.current().samples.select(*whole.samples.columns)) == rows(whole.samples)
    before = grown.version()
    grown.add(flat, before)
    assert grown.version() == before
    probe = Probe(flat, PROBE, output_path=f"{tmp_path}/bg", limit=None, name="rec")
    assert rows(probe.wait(120).nodes) == rows(whole.nodes) and not probe.running()


def test_sources(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1}\n{"a": 2}\nbroken\n{"a": -1}\n')
    good, bad = read_log(spark, str(tmp_path / "log.json"), "a int", F.col("a") == -1)
    assert rows(good) == [(1,), (2,)] and bad.first()["skipped"] == 1
    good.createOrReplaceTempView("strataview_t")
    assert "strataview_t" in list_tables(spark) and open_source(spark, "view", "strataview_t").count() == 2
    assert validate(spark, "parquet", f"{tmp_path}/none") and validate(spark, "view", "strataview_t") is None
    assert from_values(spark, ["x", "y"]).count() == 2
    assert open_source(spark, "log", str(tmp_path / "log.json")).where("record is not null").count() == 3


def test_plots():
    assert tick(0, 86400 * 365) == (86400 * 30 * 2, "%Y/%m") and tick(0, 1) == (10, "%H:%M:%S")
    assert csv_lines([('a"b', 1, 2)]) == '"ab", 1, 2'
    assert "logscale" in histogram_script("d", "o", log=True) and "xtics" in timeline_script("d", "o", 0, 10_000, 3)


def test_scan_is_pruned_and_limited_before_the_window(spark, tmp_path):
    records(spark, 50).drop("js").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    plan = probe_facts(df, "num", ALL).groupBy("class").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<num:int>" in plan
    picked = sample(probe_facts(df, "num", ALL), 16)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in picked
