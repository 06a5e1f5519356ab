import random

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_jaccard_join import brute
from tests.llm.test_toxicity import corpus, label_frame


def test_stages_on_a_planted_corpus(spark, tmp_path):
    data, labels = corpus(600)
    data = [(k, t, la or "en", f"s{k % 3}", len(t), "x", "y", "z") for k, t, la, *_ in data]
    clean = [r for r in data if r[0] % 4]
    rng = random.Random(4)
    passage = " ".join(f"bench{rng.randrange(90)}" for _ in range(40))
    copies = [(1000, clean[0][1].replace(" ", "  "), "en", "s0", 1, "x", "y", "z"), (1001, clean[1][1], "en", "s0", 1, "x", "y", "z")]
    near = [(1100 + k, clean[k][1] + " end", "en", "s1", 1, "x", "y", "z") for k in range(20, 30) if len(clean[k][1].split()) > 30]
    leaks = [(1200 + k, clean[k][1][:50] + " " + passage + " tail" * k, "en", "s1", 1, "x", "y", "z") for k in range(40, 44)]
    rows = data + copies + near + leaks + [data[1], (None, None, None, None, None, None, None, None)]
    docs = cases.frame(spark, rows)
    label_frame(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        seen.append(len(ids))
        if name == "toxicity":
            assert sum(i is not None and i < 600 and i % 4 == 0 for i in ids) <= 8
            assert sum(i is not None and i < 600 and i % 4 != 0 for i in ids) >= 440
        if name == "exact_dedup":
            assert clean[0][0] not in ids and 1000 in ids and 1001 not in ids
            assert ids.count(data[1][0]) <= 1
        if name == "near_dedup":
            groups = brute([(r.doc_id, r.text) for r in kept.collect()if r.doc_id is not None])
            assert all(g == i for i, (_, g) in groups.items())
            assert not {r[0] for r in near} & set(ids)
        if name == "decontamination":
            assert not {r[0] for r in leaks} & set(ids) and None in ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() < seen[-1] and out.columns == docs.columns


def _stage(spark, tmp_path, name, rows, benchmark=()):
    spark.createDataFrame([*benchmark], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, cases.frame(spark, rows), str(tmp_path))
    assert out.columns == cases.frame(spark, []).columns
    return sorted((r.doc_id, r.text) for r in out.collect()) if rows and all(r[0] is not None for r in rows) else [(r.doc_id, r.text) for r in out.collect()]


def _rows(*pairs):
    return [(k, t, "en", "s", 1, "x", "y", "z") for k, t in pairs]


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """Rows without id, or with an id that another row has, go only if their own text is judged."""
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    a, b, passage = text(), text(), " ".join(f"bench{rng.randrange(900)}" for _ in range(60))

    near = [(1, a), (5, a + " end"), (5, b), (None, a + " more"), (None, b + " more"), (None, text()), (None, None), (None, "")]
    kept = _stage(spark, tmp_path, "near_dedup", _rows(*near))
    assert (1, a) in kept and (5, b) in kept and len(kept) == 5 and (None, near[5][1]) in kept
    lone = _stage(spark, tmp_path, "near_dedup", _rows((None, a), (None, a + " end")))
    assert len(lone) == 1

    leaks = [(None, a), (None, a + " " + passage), (7, passage + " tail"), (7, b), (8, b)]
    assert set(_stage(spark, tmp_path, "decontamination", _rows(*leaks), [(1, passage)])) == {(None, a), (7, b), (8, b)}

    mixed = _stage(spark, tmp_path, "mixing", _rows(*((None, text()) for _ in range(200))))
    assert 60 < len(mixed) < 140

    exact = _stage(spark, tmp_path, "exact_dedup", _rows((None, a), (3, a), (3, b), (4, b + " "), (None, "x")))
    assert set(exact) == {(3, a), (4, b + " "), (None, "x")}


def test_empty_table(spark, tmp_path):
    for name in ("exact_dedup", "near_dedup", "decontamination", "mixing"):
        assert _stage(spark, tmp_path, name, [], [(1, "a passage of a benchmark that is long enough")]) == []


def test_numbers_do_not_depend_on_tasks(spark, tmp_path):
    from strataview.llm.staging import numbered

    spark.range(1000).selectExpr("id % 7 as x", "id as `odd.name`").repartition(3).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    first = {(r["odd.name"], r["__row"]) for r in numbered(docs).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        assert first == {(r["odd.name"], r["__row"]) for r in numbered(docs).where("x >= 0").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({n for _, n in first}) == 1000
