import random
import zlib

from pyspark.sql import functions as F

from strataview.llm import toxicity
from tests.llm import cases


def corpus(n=900):
    rng = random.Random(1)
    vocab = [f"word{k}" for k in range(500)]
    data, labels = [], []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Vile,", "foulest", "foulmore"])
        data.append((k, " ".join(words), rng.choice(["en", "de", None]), "a", 0, "", "", ""))
        labels.append((k, 1, int(bad)))
    return data, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    data, labels = corpus()
    got = {r.doc_id: r for r in toxicity.score_toxicity(cases.frame(spark, data), label_frame(spark, labels)).collect()}
    held = [(got[d], y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    right = sum(r.predicted == y for r, y in held)
    assert right / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_score_ignores_ids_labels_and_language(spark):
    data, labels = corpus(400)
    twice = [*data, *((d + 10_000, t, "zz", "other", *rest) for d, t, _, _, *rest in data[:50])]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(cases.frame(spark, twice), label_frame(spark, labels)).collect()}
    assert all(got[k] == got[k + 10_000] for k in range(50))


def test_edge_cases(spark):
    data, labels = corpus(200)
    rows = cases.rows()
    mixed = [*data, *((r[0] + 5000, *r[1:]) for r in rows)]
    odd = [*labels, (None, 1, 1), (3, 1, None), (10**9, 0, 1)]
    out = toxicity.score_toxicity(cases.frame(spark, mixed), label_frame(spark, odd))
    assert out.count() == len(mixed) and out.where(F.col("score").isNull()).count() == 0
    assert toxicity.score_toxicity(cases.frame(spark, []), label_frame(spark, labels)).count() == 0
    none = toxicity.score_toxicity(cases.frame(spark), label_frame(spark, []))
    assert {r.score for r in none.collect()} == {0.0}


def test_ids_with_several_labels_and_texts(spark):
    """An id is toxic if one label says so, before the sample is bounded; its text does not depend on the order of rows."""
    known = [d for d in range(400) if zlib.crc32(str(d).encode()) % 4 != 2][:40]
    labels = [(d, 1, t) for k, d in enumerate(known) for t in ((0, 1) if k < 30 else (0,))]
    rows = [(d, text, lang, "a", 0, "", "", "") for d in known for text, lang in (("one", "en"), ("two", "de"), (None, "fr"))]
    for data in (rows, rows[::-1]):
        sample, prior = toxicity.labelled_sample(cases.frame(spark, data), label_frame(spark, labels), fit_toxic=3, fit_clean=100)
        assert sorted(sample["toxic"].to_pylist()) == [0] * 10 + [1] * 3 and prior == 0.75
        assert set(sample["text"].to_pylist()) == {"two"} and set(sample["lang"].to_pylist()) == {"de"}


def test_long_texts_are_learned(spark):
    """Words that stand in long labelled texts alone count: no labelled row is left out of the fit."""
    data, labels = corpus(400)
    long = [(k, " ".join(["grimmest", *["plain"] * 2500]) if k % 2 else " ".join(["plain"] * 2500), "en", "a", 0, "", "", "") for k in range(1000, 1080)]
    short = [(k, "grimmest word7 word9" if k % 2 else "plain word7 word9", "en", "a", 0, "", "", "") for k in range(2000, 2020)]
    known = label_frame(spark, [*labels, *((r[0], 1, r[0] % 2) for r in long)])
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(cases.frame(spark, [*data, *long, *short]), known).collect()}
    assert all(got[r[0]] == r[0] % 2 for r in short)


def test_blocks_of_rows(spark, monkeypatch):
    """Every labelled row is in one block, and a model averaged over blocks tells held-out rows."""
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 150)
    data, labels = corpus()
    rows = toxicity.labelled_rows(cases.frame(spark, data), label_frame(spark, labels))
    assert {r["__id"] for r in rows.collect()} == {d for d, _, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2}
    assert rows.count() == rows.select("__id").distinct().count() and rows.select("block").distinct().count() == 5
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(cases.frame(spark, data), label_frame(spark, labels)).collect()}
    held = [got[d] == y for d, _, y in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(held) / len(held) > 0.93
