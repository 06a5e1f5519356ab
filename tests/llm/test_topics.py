"""Topics against the same rounds over all vectors in memory, and on texts of known vocabularies."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataview.llm.mixing import mix_sources
from strataview.llm.staging import stage
from strataview.llm.textkit import text_buffers
from strataview.llm.topics import DIMENSIONS, fit_topics, nearest, split, topic_of, with_vectors, word_vectors
from tests.llm.cases import DOC, frame


def plain_fit(vectors, splits, rounds):
    vectors = vectors[vectors.any(axis=1)].astype(np.int64)

    def sums(centres):
        whose = nearest(vectors, centres)
        groups = [vectors[whose == c] for c in range(len(centres))]
        return np.array([len(g) for g in groups]), np.array([g.sum(axis=0) for g in groups], float), np.array([(g**2).sum(axis=0) for g in groups], float)

    def means(centres, n, first):
        return np.array([first[c] / n[c] if n[c] else centres[c] for c in range(len(centres))])

    centres = np.zeros((1, DIMENSIONS))
    n, first, second = sums(centres)
    centres = means(centres, n, first)
    for _ in range(splits):
        centres = split(centres, n, first, second)
        for _ in range(rounds):
            n, first, second = sums(centres)
            centres = means(centres, n, first)
    return centres


def test_rounds_over_tasks_equal_rounds_in_memory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vectored = stage(with_vectors(docs.repartition(7)), "vectors")
    centres = fit_topics(vectored)
    local = docs.toArrow().combine_chunks()
    vectors, words = word_vectors(*text_buffers(local["text"]))
    assert np.array_equal(centres, plain_fit(vectors, 3, 2))
    found = {r.doc_id: (r.topic, r.n_tokens) for r in vectored.select("doc_id", "n_tokens", topic_of(centres, F.col("vector")).alias("topic")).collect()}
    whose = nearest(vectors.astype(np.int64), centres)
    assert found == {d: ("none" if c < 0 else f"topic{c}", n) for d, c, n in zip(local["doc_id"].to_pylist(), whose.tolist(), words.tolist(), strict=True)}
    assert len({t for t, _ in found.values()}) > 3


def test_vocabularies_part(spark):
    rng = random.Random(3)
    fields = [[f"{name}{k}" for k in range(40)] for name in ("star", "leaf")]
    data = [(k, " ".join(rng.choice(fields[k % 2]) for _ in range(80 + 40 * (k % 3))), "en", "a", 0, "", "", "") for k in range(60)]
    vectored = stage(with_vectors(frame(spark, data).select("doc_id", "text")), "vectors")
    topics = {r.doc_id: r.topic for r in vectored.select("doc_id", topic_of(fit_topics(vectored, splits=1, rounds=3), F.col("vector")).alias("topic")).collect()}
    assert len({topics[k] for k in range(0, 60, 2)}) == len({topics[k] for k in range(1, 60, 2)}) == 1 and topics[0] != topics[1]


def test_awkward_documents(spark):
    mixed = mix_sources(frame(spark), topics_by="words").collect()
    topics = {r.doc_id: r.topic for r in mixed}
    assert topics[5] == topics[6] == topics[7] == "none"  # empty, null, blanks
    assert topics[0] == topics[1] == topics[2] == topics[3] and topics[8] == topics[9]  # same words, same topic
    assert len(mixed) == frame(spark).count() and all(0 <= r.probability <= 1 for r in mixed)
    none = spark.createDataFrame([], DOC)
    assert mix_sources(none, topics_by="words").collect() == []
    assert {r.topic for r in mix_sources(frame(spark)).collect()} <= {"table", "symbols", "numeric", "long", "prose"}
