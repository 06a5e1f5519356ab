import random

import numpy as np

from strataview.llm import decontaminate as dc
from tests.llm import cases


def edits(item, text):
    """Least edits of item against any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def fold(text):
    return dc._FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def damaged(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([["x"], [], [chars[k], "y"]])
    return "".join(chars)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    syllables = ["the ", "of ", "tion", "er", "ing ", "an", "st ", "ré", "ly\n"]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [(k, text(rng.randint(20, 60))) for k in range(12)]
    items += [(20, items[0][1]), (21, None), (22, "short"), (23, "The Of " * 12)]
    data = []
    for k in range(60):
        body = text(rng.randint(0, 80))
        if k % 2:
            item = rng.choice(items[:12])[1]
            body += damaged(rng, item, rng.randint(0, int(len(item) * 0.12))) + text(30)
        data.append((k, body.upper() if k % 5 == 0 else body, "en", "a", 0, "", "", ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK_BYTES, 500):
        got = {(r.doc_id, r.item_id): r for r in dc.find_contamination(cases.frame(spark, data), bench, block_bytes=block).collect()}
        want = {}
        for d in data:
            for i, t in items:
                t = fold(t)
                if len(t) >= dc.LEAST:
                    budget = int(len(t) * dc.EDIT_SHARE)
                    if (e := edits(t, fold(d[1]))) <= budget:
                        want[d[0], i] = e
        assert {k: r.distance for k, r in got.items()} == want
        assert len(want) > 15
    some = next(r for r in got.values() if r.distance == 0)
    assert fold(data[some.doc_id][1].encode().decode()[some.start : some.end]) == fold(dict(items)[some.item_id])


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, cases.rows()[0][1]), (None, cases.rows()[0][1])], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id is None) for r in dc.find_contamination(cases.frame(spark), bench).collect())
    assert {d for d, _ in got} == {0, 1, 2, 4, 17} and len(got) == 12
    assert dc.find_contamination(cases.frame(spark, []), bench).count() == 0
    assert dc.find_contamination(cases.frame(spark), bench.limit(0)).count() == 0


def test_items_of_every_size(spark):
    """Short items too, each with the whole budget of its size."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    items = [(k, text(k)) for k in range(1, 64)]
    data = []
    for k in range(120):
        item = items[k % 63][1]
        budget = int(len(item) * dc.EDIT_SHARE)
        data.append((k, text(40) + damaged(rng, item, rng.randint(0, budget + 1)) + text(40), "en", "a", 0, "", "", ""))
    got = {(r.doc_id, r.item_id): r.distance for r in dc.find_contamination(cases.frame(spark, data), spark.createDataFrame(items, "item_id long, text string"), least=1).collect()}
    want = {(d[0], i): e for d in data for i, t in items if (e := edits(fold(t), fold(d[1]))) <= int(len(t) * dc.EDIT_SHARE)}
    assert got == want
    assert {25, 28, 38, 39} <= {i for _, i in want}


def test_many_texts_and_items():
    """Text and item numbers together exceed 32 bits."""
    rng = np.random.default_rng(3)
    index = dc.Index([([k], rng.integers(97, 123, 24).astype(np.uint8).tobytes()) for k in range(200_000)])
    data = rng.integers(65, 91, 24 * 30_000).astype(np.uint8)
    data[-24:] = index.texts[-1]
    found = dc.find_items(index, data, np.arange(30_001) * 24)
    assert [(t, i, d) for t, i, _, _, d, _ in found] == [(29_999, 199_999, 0)]
