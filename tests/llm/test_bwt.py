import random
from collections import Counter

import numpy as np

from strataview.llm import bwt, repeats


def naive(texts):
    rows = sorted(((t[k:], j, t[k - 1] + 1 if k else 0) for j, t in enumerate(texts) for k in range(len(t) + 1)), key=lambda r: ([c + 1 for c in r[0]] + [0], r[1]))
    return [r[2] for r in rows]


def test_transform_and_merge():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(9)]
    assert bwt.transform(texts).tolist() == naive(texts)
    merged, _ = bwt.merge(bwt.transform(texts[:4]), bwt.transform(texts[4:]))
    assert merged.tolist() == naive(texts)
    owner, back = bwt.suffix_places(merged)
    assert sorted(zip(owner.tolist(), back.tolist(), strict=True)) == sorted((j, k) for j, t in enumerate(texts) for k in range(len(t) + 1))


def test_spans_equal_windows():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abc") for _ in range(60))
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 80))) + (shared[rng.randint(0, 9) :] if k % 2 else b"") for k in range(20)] + [b"", b"x" * 50]
    counts = Counter(t[k : k + 20] for t in texts for k in range(len(t) - 19))
    want = [repeats.merge_ranges([(k, k + 20) for k in range(len(t) - 19) if counts[t[k : k + 20]] > 1]) for t in texts]
    for shards in (1, 2, 3):
        assert bwt.repeated_spans(texts, 20, shards) == want
    assert np.count_nonzero([len(w) for w in want]) > 8
