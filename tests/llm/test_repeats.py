import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from strataview.llm import repeats
from tests.llm import cases


def brute(data, length=400):
    texts = [(r[1] or "").encode() for r in data]
    counts = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for row, t in zip(data, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((row[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted((a + b for a, b in zip(out, passages(data), strict=True)), key=str)


def passages(data, size=51):
    """Per row: maximal word ranges of which each ``size`` words occur in another document, and their words."""
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in data]
    holders = {}
    for row, w in zip(data, words, strict=True):
        for k in range(len(w) - size + 1):
            holders.setdefault(w[k : k + size], set()).add((row[0], row[1]))
    out = []
    for w in words:
        held = np.zeros(len(w) + 2, bool)
        for k in range(len(w) - size + 1):
            if len(holders[w[k : k + size]]) > 1:
                held[k + 1 : k + 1 + size] = True
        out.append((int(np.count_nonzero(held[1:] & ~held[:-1])), int(held.sum())))
    return out


def check(spark, data):
    got = [tuple(r) for r in repeats.remove_repeats(cases.frame(spark, data).repartition(4)).collect()]
    assert sorted(got, key=str) == brute(data)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (300, 380, 390, 399, 400, 401, 450, 700, 1500)]
    data = []
    for k in range(60):
        parts = [text(rng.randint(0, 500))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.choice([0, 0, 1, 7]) :], text(rng.randint(0, 300))]
        data.append((k, "".join(parts), "en", "a", 0, "", "", ""))
    data += [data[3], data[5], (90, data[3][1], "en", "a", 0, "", "", ""), (91, "ab" * 900, "en", "a", 0, "", "", ""), (92, "x" * 401, "", "", 0, "", "", ""), (93, "y" * 400, "", "", 0, "", "", "")]
    check(spark, data)


def test_edge_cases(spark):
    check(spark, cases.rows()[:11] + cases.rows()[13:])
    assert repeats.remove_repeats(cases.frame(spark, [])).count() == 0


def test_passages_of_short_words(spark):
    """Passages shorter than a byte window; copies within one document do not count."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 52, 60, 120)]
    data = []
    for k in range(60):
        parts = [[word() for _ in range(rng.randint(0, 70))]]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared)[rng.choice([0, 0, 1, 5]) :], [word() for _ in range(rng.randint(0, 30))]]
        text = rng.choice(["\n", " ", "\t "]).join(w.upper() if k % 5 == 0 else w for p in parts for w in p)
        data.append((k, text, "en", "a", 0, "", "", ""))
    own = " ".join(word() for _ in range(70))
    data += [(80, own + " and " + own, "en", "a", 0, "", "", ""), (81, "x " * 101, "", "", 0, "", "", ""), data[7]]
    assert any(n and len(r[1]) for r, (n, _) in zip(data, passages(data), strict=True))
    check(spark, data)


def test_anchors_of_many_variants(spark, monkeypatch):
    """Beyond HOT variants windows are counted row by row, with the same result."""
    monkeypatch.setattr(repeats, "HOT", 2)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (300, 420, 700, 1200)]
    check(spark, [(k, text(rng.randint(0, 300)) + rng.choice(shared)[rng.choice([0, 3]) :] + text(rng.randint(0, 300)), "en", "a", 0, "", "", "") for k in range(50)])


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "_POSITION_BITS", 11)
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("abcd") for _ in range(6000)).encode(), np.uint8)
    windows = []
    for whose, first, n, *_ in repeats.long_runs(repeats.byte_symbols(data), np.array([0, 6000]), repeats.LENGTH, repeats.GRAM):
        assert not whose.any()
        windows += [int(f + s) for f, k in zip(first, n, strict=True) for s in range(k)]
    assert windows == list(range(6000 - 399))


def test_sliding_min():
    values = np.random.default_rng(0).integers(0, 50, 100).astype(np.uint64)
    assert (repeats.sliding_min(values, 7) == np.lib.stride_tricks.sliding_window_view(values, 7).min(axis=1)).all()


def test_windows_compared_in_parts():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 600, np.uint8)
    texts, n = [], rng.integers(1, 120, 300)
    for size in n:
        text = base[: size - 1 + repeats.LENGTH].copy()
        if rng.random() < 0.7:
            text[rng.integers(0, len(text))] = 33
        texts.append(text.tobytes())
    args = (repeats.BYTES, n, np.full(300, 130), np.repeat(np.arange(6), 50), pa.array(texts, pa.binary()), np.arange(300), np.arange(300))
    flags, step = repeats.shared_flags(*args)
    seen = {}
    places = [(run // 50, k, texts[run][k : k + repeats.LENGTH], run) for run in range(300) for k in range(n[run])]
    for anchor, k, window, run in places:
        seen.setdefault((anchor, k, window), set()).add(run)
    assert flags.tolist() == [len(seen[p[:3]]) > 1 for p in places] and 0 < flags.sum() < len(flags)
    assert step.tolist() == [p[1] for p in places]
    for limit in (1, 50, 1000):
        assert (repeats.shared_flags(*args, limit=limit)[0] == flags).all()
