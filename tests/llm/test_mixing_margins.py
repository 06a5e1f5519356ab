"""Mixing against plain iterative proportional fitting, and the report of what is not met."""

import random
from collections import defaultdict

import pytest

from strataview.llm import mixing
from tests.llm import cases

GIVEN = {"source": {"a": 0.5, "b": 0.3, mixing.NULL: 0.2}, "lang": {"en": 0.5, "de": 0.4, mixing.NULL: 0.1}}


def documents():
    rng = random.Random(3)
    texts = lambda: rng.choice(["w " * rng.randint(0, 80), "| x |" * rng.randint(1, 9), "12 34 " * rng.randint(1, 20)])
    return [(k, texts(), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0, "", "", "") for k in range(800)]


def plain(rows, given, share=mixing.SAMPLE_SHARE, rounds=mixing.ROUNDS):
    """Tokens asked of each cell over dicts: fit one margin after another, and never ask for more than there is."""
    have = defaultdict(float)
    for r in rows:
        have[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(have.values())
    goals = []
    for at, margin in enumerate(mixing.MARGINS):
        sums = defaultdict(float)
        for cell, n in have.items():
            sums[cell[at]] += n
        weight = given.get(margin) or {v: (n / total) ** mixing.TEMPERATURES[margin] if n else 0.0 for v, n in sums.items()}
        goals.append({v: w / sum(weight.values()) * share * total for v, w in weight.items()})
    want = {cell: n * share for cell, n in have.items()}
    for _ in range(rounds):
        for at, goal in enumerate(goals):
            now = defaultdict(float)
            for cell, n in want.items():
                now[cell[at]] += n
            want = {cell: min(n * goal.get(cell[at], 0.0) / now[cell[at]] if now[cell[at]] else 0.0, have[cell]) for cell, n in want.items()}
    return have, want


@pytest.mark.parametrize("given", [{}, GIVEN, {"source": {"a": 0.1, "b": 0.9}}])
def test_probabilities_equal_plain_fitting(spark, given):
    rows = mixing.mix_sources(cases.frame(spark, documents()), given).collect()
    have, want = plain(rows, given)
    for r in rows:
        cell = (r.source, r.lang, r.topic)
        assert r.probability == pytest.approx(want[cell] / have[cell] if have[cell] else mixing.SAMPLE_SHARE, abs=1e-9)


def test_report_names_what_is_not_met(spark):
    docs = cases.frame(spark, documents())
    report = {(r.margin, r.value): r for r in mixing.margin_report(mixing.mix_sources(docs, GIVEN), GIVEN).collect()}
    assert max(abs(r.residual) for r in report.values()) < 1e-3
    scarce = {"source": {"a": 0.05, "b": 0.9, "none": 0.05}}
    report = {(r.margin, r.value): r for r in mixing.margin_report(mixing.mix_sources(docs, scarce), scarce).collect()}
    b, none = report["source", "b"], report["source", "none"]
    assert b.residual < -0.2 and b.expected == pytest.approx(b.tokens)
    assert (none.tokens, none.expected) == (0, 0.0) and none.residual == pytest.approx(-0.05)
    assert report["source", mixing.NULL].goal == 0 and report["source", mixing.NULL].expected == 0
    assert mixing.margin_report(mixing.mix_sources(cases.frame(spark, []))).count() == 0
