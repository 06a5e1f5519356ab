"""Framed logs with damage, in byte ranges and as streams."""

import glob
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strataview.operators.postproc import neighbour_of, nth_child, siblings_of
from strataview.plans.options import make_options
from strataview.plans.profile import probe_facts, profile
from strataview.plans.spec import RawSpec
from strataview.sources.framed import MARK, read_framed, stream_framed, write_log
from strataview.streaming.incremental import IncrementalSpec

SCHEMA = "id long, txt string, at timestamp, l array<int>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def records(spark, n, parts=1):
    texts = F.element_at(F.array(*map(F.lit, ["plain", "ü€😀", 'quote " and \\', "line\nfeed", "", "\x1eLOG in a text"])), (F.col("id") % 6 + 1).cast("int"))
    return spark.range(n).repartition(parts).select("id", F.when(F.col("id") % 7 > 0, texts).alias("txt"), F.expr("timestamp_micros(id * 1234567)").alias("at"), F.expr("sequence(1, cast(id % 4 as int) + 1)").alias("l"))


def only_file(path):
    return glob.glob(f"{path}/part-*")[0]


def naive(data):
    """Ids of the whole records of a log's bytes, and the bytes that belong to no frame."""
    ids, skipped = [], 0
    for k, chunk in enumerate(data.split(MARK.encode())):
        if not chunk:
            continue
        try:
            assert chunk[:1] in (b"H", b"R") and all(c in b"0123456789abcdef" for c in chunk[1:17])
            size, crc = int(chunk[1:9], 16), int(chunk[9:17], 16)
            content = chunk[17 : 17 + size]
            assert len(content) == size and zlib.crc32(content) == crc
        except (AssertionError, ValueError):
            skipped += len(chunk) + len(MARK)
            continue
        skipped += max(0, len(chunk) - 18 - size)
        if chunk[:1] == b"R":
            ids.append(json.loads(content)["id"])
    return ids, skipped


def test_round_trip_and_ranges(spark, tmp_path):
    df = records(spark, 500, 3)
    write_log(df, f"{tmp_path}/log", {"name": "x"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        log = read_framed(spark, f"{tmp_path}/log", SCHEMA)
        assert log.records.rdd.getNumPartitions() > 10
        assert rows(log.records) == rows(df)
        assert rows(log.headers.select("header")) == [('{"name": "x"}',)] * 3
        assert [tuple(r) for r in log.report.agg(F.sum("records"), F.sum("skipped_bytes"), F.sum("damaged")).collect()] == [(500, 0, 0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_damaged_bytes_are_skipped_and_counted(spark, tmp_path):
    write_log(records(spark, 300), f"{tmp_path}/log", {"name": "x"})
    with open(only_file(f"{tmp_path}/log"), "rb") as file:
        whole = file.read()
    rng = random.Random(2)
    for k in range(6):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 12)):
            at, n = rng.randrange(len(data)), rng.choice([1, 3, 400])
            data[at : at + n] = bytes(rng.randrange(256) for _ in range(n)) if rng.random() < 0.6 else b""
        if k % 2:
            data = data[: -rng.randrange(1, 200)]
        with open(f"{tmp_path}/damaged-{k}.log", "wb") as file:
            file.write(data)
        log = read_framed(spark, f"{tmp_path}/damaged-{k}.log", SCHEMA)
        ids, skipped = naive(bytes(data))
        assert sorted(r["id"] for r in log.records.collect()) == sorted(ids) and 100 < len(ids) < 300
        report = log.report.first()
        assert (report["records"], report["skipped_bytes"], report["is_skipped"]) == (len(ids), skipped, False)


def test_files_that_are_no_logs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.log").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "d" / "b.log").write_bytes(b"")
    log = read_framed(spark, f"{tmp_path}/d", SCHEMA)
    assert log.records.collect() == [] and log.headers.collect() == []
    assert [(r["is_skipped"], r["records"]) for r in log.report.collect()] == [(True, 0)]


def test_stream_restart_replay_and_folding(spark, tmp_path):
    probe, options = (0, {"ts": "at", "key": "id"}), dict(name="rec", categorical=("$.txt",))
    for k in range(3):
        write_log(records(spark, 60).where(F.col("id") % 3 == k).coalesce(1), f"{tmp_path}/in", {"part": k}, mode="append")
    grown = IncrementalSpec(spark, f"{tmp_path}/s", probe, fold_every=2, **options)
    source = lambda: stream_framed(spark, f"{tmp_path}/in", SCHEMA, maxFilesPerTrigger=1)
    grown.start(source(), f"{tmp_path}/c").awaitTermination()
    whole = profile(records(spark, 60), probe, limit=None, **options)

    def same(want):
        got = grown.current()
        for table in ("nodes", "registers", "samples", "dictionary", "histogram", "extremes"):
            columns = getattr(want, table).columns
            assert rows(getattr(got, table).select(*columns)) == rows(getattr(want, table)), table

    same(whole)
    assert grown.version() == 2 and 0 <= grown.folded() <= 2

    # replayed batches count once, whether folded or not
    for batch in (0, grown.version()):
        grown.add(records(spark, 60).where(F.col("id") % 3 == 2) if batch > grown.folded() else records(spark, 5), batch)
    same(whole)

    # a restart goes on after what was read
    write_log(records(spark, 90).where("id >= 60").coalesce(1), f"{tmp_path}/in", {"part": 3}, mode="append")
    grown = IncrementalSpec(spark, f"{tmp_path}/s", probe, fold_every=2, **options)
    grown.start(source(), f"{tmp_path}/c").awaitTermination()
    same(profile(records(spark, 90), probe, limit=None, **options))
    grown.fold()
    assert grown.folded() == grown.version() == 3
    same(profile(records(spark, 90), probe, limit=None, **options))
    with pytest.raises(ValueError):
        IncrementalSpec(spark, f"{tmp_path}/s", probe, samples=4, **options).add(records(spark, 5), 9)


def test_stopped_stream_leaves_a_spec(spark, tmp_path):
    write_log(records(spark, 30), f"{tmp_path}/in")
    grown = IncrementalSpec(spark, f"{tmp_path}/s", 0, name="rec")
    query = grown.start(stream_framed(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/c", processingTime="1 second")
    query.processAllAvailable()
    query.stop()
    assert grown.current().nodes.where("path = '$'").first()["n"] == 30


def test_variants_of_any_depth(spark, tmp_path):
    deep = "[" * 40 + "7" + "]" * 40
    df = spark.createDataFrame([(deep,), ('{"a[": {"b": [{"c": []}, {"c": [null, "[{"]}]}}',), (None,), ("3",)], "j string").select(F.try_parse_json("j").alias("v"))
    counts = {(r["path"], r["class"]): r["count"] for r in probe_facts(df, "v", make_options(limit=None)).groupBy("path", "class").count().collect()}
    assert counts["$" + "[]" * 40, "byte"] == 1 and counts["$" + "[]" * 39, "nonempty_list"] == 1
    assert counts["$.a\\[.b[].c", "[]"] == counts["$.a\\[.b[].c", "nonempty_list"] == counts["$.a\\[.b[].c[]", "binary"] == counts["$.a\\[.b[].c[]", "null"] == 1
    assert sum(counts.values()) == 41 + 9 + 2
    spec = profile(df, "v", limit=None, variant_depth=2, output_path=f"{tmp_path}/cut")
    assert RawSpec.load(spark, f"{tmp_path}/cut").meta["truncated"] == ["$.a\\[.b", "$[][]"] and spec.meta["processed"] == 4


def test_moves_follow_the_fields(spark):
    spec = profile(spark.createDataFrame([(1, "x", {"q": 1, "p": 2})], "zeta int, alpha string, m map<string,int>"), 0, limit=None, name="r")
    fields = spec.meta["fields"]
    assert [r["path"] for r in nth_child(spec.nodes, "$", 1, fields).collect()] == ["$.zeta"]
    assert [r["path"] for r in neighbour_of(spec.nodes, "$.zeta", 1, fields).collect()] == ["$.alpha"]
    assert neighbour_of(spec.nodes, "$.zeta", -1, fields).collect() == []
    assert rows(siblings_of(spec.nodes, "$.m.q", fields).select("path", "place")) == [("$.m.p", 1), ("$.m.q", 2)]


def test_a_variant_is_opened_once():
    """The kind of a value, for which all that it holds is read, stands once in the expression of its facts, and never for a list or map."""
    from strataview.operators.flatten import variant_facts

    assert str(variant_facts(F.col("v"), F.lit("$"), None)).count("schema_of_variant") == 1
