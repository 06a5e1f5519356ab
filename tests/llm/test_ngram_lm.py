import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataview.llm import ngram_lm as lm
from tests.llm import cases

D = lm.DISCOUNT


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Naive:
    """The same model with dictionaries, one token at a time along arcs and failure arcs."""

    def __init__(self, texts, order, strengths):
        self.order, self.strengths = order, strengths
        self.c = Counter()
        for t in texts:
            for k in range(1, order + 1):
                self.c.update(tuple(t[i - k : i]) for i in range(k, len(t) + 1))
        self.n = sum(c for g, c in self.c.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.c)

    def p(self, h, w):
        if not h:
            c = self.c[(w,)]
            return ((c - D) if c else D * self.v + 1) / (self.n + 1)
        m = self.strengths[len(h) - 1]
        failure = m / (self.c[h] + m)
        return self.c[(*h, w)] / (self.c[h] + m) + failure * self.p(h[1:], w)

    def score(self, text):
        state, total = (), 0.0
        for w in text:
            total += math.log10(self.p(state, w))
            state = (*state, w)[-(self.order - 1) :]
        return total


def corpus():
    rng = random.Random(1)
    vocab = [f"W{k}" for k in range(50)]
    data = []
    for k in range(150):
        words = [vocab[min(int(rng.expovariate(0.15)), 49)] for _ in range(rng.randint(0, 60))]
        data.append((k, " ".join(words) + (f" only{k}" if k % 3 == 0 else ""), "en", "a", 0, "", "", ""))
    return data + [(k + 200, *r[1:]) for k, r in enumerate(cases.rows())]


@pytest.mark.parametrize(("order", "block_bytes", "range_keys", "from_file"), [(3, 1000, 5000, False), (2, 1 << 20, 4_000_000, True)])
def test_equals_naive_traversal(spark, tmp_path, order, block_bytes, range_keys, from_file):
    data, strengths = corpus(), (3.0, 1.5)
    docs = cases.frame(spark, data)
    if from_file:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r for r in lm.score_documents(docs, order=order, strengths=strengths, block_bytes=block_bytes, range_keys=range_keys).collect()}
    assert len(got) == len(data)
    naive = Naive([tokens(r[1]) for r in data if zlib.crc32(str(r[0]).encode()) % 10], order, strengths)
    for row in data:
        text, r = tokens(row[1]), got[row[0]]
        assert r.held_out == (zlib.crc32(str(row[0]).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(text), sum(naive.c[(w,)] > 0 for w in text), naive.n)
        base = sum(math.log10((naive.c[(w,)] + 0.1) / (naive.n + 0.1 * (naive.v + 1))) for w in text)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, naive.score(text), rel_tol=1e-9, abs_tol=1e-9), row
        assert math.isclose(r.mean_score * r.n_tokens, r.score, rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    naive = Naive([tokens(" ".join(rng.choice("abcab") for _ in range(30))) for _ in range(40)], 3, (5.0, 2.0))
    words = ["a", "b", "c", "</s>", "unknown"]
    for h in [(), ("a",), ("b", "c"), ("unknown",), ("a", "unknown")]:
        assert math.isclose(sum(naive.p(h, w) for w in words), 1, abs_tol=1e-9)


def test_chunks_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (lm.decode_sorted(lm.encode_sorted(keys)) == keys).all()
    assert (lm.decode(lm.encode(keys[:7])) == keys[:7]).all()
    assert len(lm.decode(lm.encode(keys[:0]))) == 0


def test_edge_cases(spark):
    got = lm.score_documents(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows()) and all(r.score <= 0 and np.isfinite(r.base_score) for r in got)
    assert lm.score_documents(cases.frame(spark, [])).count() == 0
    only_held = [(k, "a b", "", "", 0, "", "", "") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert {r.score for r in lm.score_documents(cases.frame(spark, only_held)).collect()} == {0.0}


@pytest.mark.parametrize(("order", "segment"), [(3, 1024), (3, 4), (4, 5), (2, 3), (1, 7)])
def test_visited_states_equal_the_naive_walk(monkeypatch, order, segment):
    """Only trained n-grams are states and arcs, and each step ends in the longest trained context."""
    monkeypatch.setattr(lm, "SEGMENT", segment)
    rng = random.Random(order * 10 + segment)
    train = [[rng.choice("aaabbcde") for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    texts = [[rng.choice("aabbcdxyz") for _ in range(rng.randrange(1, 60))] for _ in range(30)]
    strengths = (5.0, 2.0, 1.0)
    naive = Naive(train, order, strengths)
    ids = {w: np.uint64(k * 7919 + 13) for k, w in enumerate("abcdexyz")}
    flat = [w for t in texts for w in t]
    tokens_, owner = np.array([ids[w] for w in flat], np.uint64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]).astype(np.int32)
    starts = np.cumsum([0, *map(len, texts)])

    def counts(level):
        keys, at = lm.grams(tokens_, owner, level + 1)
        by_key = {int(k): naive.c[tuple(flat[a - level : a + 1])] for k, a in zip(keys, at, strict=True)}
        return np.array([by_key[k] for k in sorted(by_key)], np.int64)

    automaton = lm.Automaton(tokens_, owner, order, counts, naive.n, naive.v, strengths)
    held = {tuple(t[i : i + k]) for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1)}
    trained = {g for g in held if naive.c[g]}
    assert len(automaton.keys) == sum(len(g) > 1 for g in trained) and len(automaton.fails) == 1 + sum(len(g) < order for g in trained)
    visited = {}
    logs = automaton.traverse(lambda places, states: visited.update(zip(places.tolist(), states.tolist(), strict=True)))
    contexts = {}
    for k, text in enumerate(texts):
        for i in range(len(text)):
            suffix = next((tuple(text[i + 1 - n : i + 1]) for n in range(min(order - 1, i + 1), 0, -1) if naive.c[tuple(text[i + 1 - n : i + 1])]), ())
            assert contexts.setdefault(suffix, visited[starts[k] + i]) == visited[starts[k] + i]
            assert math.isclose(logs[starts[k] + i], math.log10(naive.p(tuple(text[max(0, i - order + 1) : i]), text[i])), rel_tol=1e-9)
    assert len(set(contexts.values())) == len(contexts) and contexts.get((), 0) == 0


def test_nothing_trained_gives_no_arcs():
    automaton = lm.Automaton(np.arange(4, dtype=np.uint64), np.zeros(4, np.int32), 3, lambda level: np.zeros(4 - level, np.int64), 0, 0)
    assert len(automaton.keys) == 0 and len(automaton.fails) == 1 and (automaton.traverse() == 0).all()
