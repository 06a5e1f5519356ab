"""Spelling variants against comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from strataview.llm.spelling import group_variants, near_words, roots
from tests.llm.cases import DOC, frame, rows


def vocabulary(docs, least, occurrences, damage):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= occurrences}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(docs, least=7, occurrences=2, factor=10, damage=None):
    n = vocabulary(docs, least, occurrences, damage)
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], near[w], form[w], n[form[w]] if form[w] is not None else None, root)
    return out


def found(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aaab" if k % 3 else "aabé") for _ in range(rng.randrange(6, 10))) for k in range(150)]
    weights = [10 ** rng.uniform(0, 3) for _ in words]
    picked = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(k, picked(400)) for k in range(12)]
    return [*docs, (None, picked(100)), (None, picked(100)), (90, None), (91, ""), (92, "ABCDEFG abcdefg abcdéfg ÀBCDEFGH àbcdefgh"), (93, "x" * 5000 + " " + "x" * 5000)]


def test_matches_all_pairs(spark):
    for damage in (None, 31, 3):
        docs = texts(4)
        got = found(group_variants(frame(spark, [(k, t, None, None, 0, "x", "y", "z") for k, t in docs]), damage=damage))
        want = expected(docs, damage=damage)
        assert got == want
        assert sum(v[1] for v in want.values()) > 20 and any(v[2] for v in want.values())


def test_short_words_and_chains(spark):
    docs = [(1, "a " * 2 + "ab " * 20 + "abc " * 200 + "abcd " * 2000 + "zz zz")]
    got = found(group_variants(frame(spark, [(k, t, None, None, 0, "x", "y", "z") for k, t in docs]), least=1))
    assert got == expected(docs, least=1) and got["a"][4] == "abcd"


def test_awkward_rows(spark):
    assert found(group_variants(frame(spark), least=4)) == expected([(r[0], r[1]) for r in rows()], least=4)
    assert group_variants(frame(spark, [])).collect() == []


def test_no_pairs_are_made(spark):
    """A group of many words gives a row a word, not a row a pair."""
    near = near_words(spark.createDataFrame([(f"abcdef{chr(0xC0 + k)}", k + 2) for k in range(60)], "word string, n long"), 7)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert {r["n_near"] for r in near.collect()} == {59} and {r["near_n"] for r in near.collect()} == {61, 60}


def test_roots_follow_to_the_end(spark):
    forms = [(str(k), str(k + 1)) for k in range(20)]
    assert {r["word"]: r["root"] for r in roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {str(k): "20" for k in range(20)}


def test_query(spark):
    from strataview.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = found(QUERIES["op12_spelling"](spark, sf))
    n = vocabulary(docs, 7, 2, 31)
    assert {w: v[0] for w, v in got.items()} == n
    sample = set(sorted(n)[::40])
    for w in sample:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        assert got[w][1:3] == (len(others), best if best is not None and n[best] >= 10 * n[w] else None)
    assert DOC is not None
