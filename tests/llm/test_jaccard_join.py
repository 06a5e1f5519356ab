import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from strataview.llm import jaccard_join as jj
from strataview.llm.components import connected_components
from tests.llm import cases

LARGE = 16


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(data):
    ids = sorted({r[0] for r in data})
    sets = {r[0]: shingles(r[1]) for r in data}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rng, n=260):
    vocab = [f"w{k}" for k in range(400)]
    line = [rng.choice(vocab) for _ in range(30)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.6:
            words = list(rng.choice(out[-40:]))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words += [rng.choice(vocab) for _ in range(rng.randint(1, 12))]
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(1, 90))] + (line if rng.random() < 0.4 else [])
        out.append(words)
    return [(k, " ".join(w).upper() if k % 7 == 0 else "\n".join(w), "en", "a", 0, "", "", "") for k, w in enumerate(out)]


def check(spark, data):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(cases.frame(spark, data).repartition(5)).collect()}
    assert got == brute(data)


def test_equals_brute_force(spark):
    check(spark, corpus(random.Random(1)))


def test_tiles_and_copies(spark, monkeypatch):
    monkeypatch.setattr(jj, "QUERIES_A_COPY", 3)
    monkeypatch.setattr(jj, "TILE", 7)
    check(spark, corpus(random.Random(2), 160))


def test_without_groups(spark, monkeypatch):
    """Groups only order the work: with useless keys every link comes through the matrix."""
    monkeypatch.setattr(jj, "band_keys", lambda tokens, at: np.arange((len(at) - 1) * jj.BANDS).reshape(-1, jj.BANDS) + int(tokens[:1].sum() >> np.uint64(2)))
    check(spark, corpus(random.Random(4), 160))


def test_one_group(spark, monkeypatch):
    """All nodes in a single group: every link comes from its tiles."""
    monkeypatch.setattr(jj, "band_keys", lambda tokens, at: np.tile(np.arange(jj.BANDS), (len(at) - 1, 1)))
    monkeypatch.setattr(jj, "TILE", 50)
    check(spark, corpus(random.Random(5), 160))


def test_intersections():
    """Pair by pair, in products, and several products wide."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 60))) for _ in range(300)] + [np.unique(rng.integers(0, 9000, 4000)) for _ in range(20)]
    tokens, whose = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, whose = np.unique(tokens[order], return_inverse=True)[1], whose[order]
    asks, opened = np.arange(0, 320, 1), np.arange(0, 320, 1)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jj.intersections(tokens, whose, asks, opened) == want).all()
    assert (jj.intersections(tokens, whose, asks[::9], opened[5:]) == want[::9, 5:]).all()


def test_link_into_a_large_group(spark):
    """x links to y alone; what x shares with y's group is early in other members, late in y."""
    rng = random.Random(3)
    own_x, own_y, early, lacking, late = ([f"{name}{k}" for k in range(n)] for name, n in (("x", 57), ("y", 57), ("e", 11), ("d", 40), ("l", 292)))
    texts = [own_x + early + lacking + late, own_y + early + lacking + late]
    texts += [rng.sample(own_y, 20) + early + late for _ in range(LARGE + 1)]
    # make the early tokens the rarest of the shared ones, and take the places of heads
    texts += [early + lacking + late + [f"f{k}-{i}" for i in range(300)] for k in range(40)]
    texts += [lacking + late + [f"g{k}-{i}" for i in range(300)] for k in range(20)]
    sets = [set(t) for t in texts]
    linked = {(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert [p for p in linked if 0 in p] == [(0, 1)]
    group = set(range(LARGE + 3))
    assert all(b in group for _, b in linked) and all((1, k) in linked for k in group - {0, 1})
    data = [(k, " ".join(t), "en", "a", 0, "", "", "") for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jj.jaccard_join(cases.frame(spark, data), words=1).collect()}
    assert got == {k: 0 if k in group else k for k in range(len(texts))}


def test_edge_cases(spark):
    check(spark, cases.rows())
    assert jj.jaccard_join(cases.frame(spark, [])).count() == 0


def test_shared_only_across_batches():
    rng = np.random.default_rng(0)
    rows = np.unique(rng.integers(0, 30, (200, 2)), axis=0)
    counts = np.bincount(rows[:, 0])
    for size in (1, 2, 3, 7, 500):
        columns = [rows[:, 0], rows[:, 1], (rows[:, 1] * 2).astype(np.int32), (rows[:, 1] * 3).astype(np.int32)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in columns], ["token", "node", "rank", "size"]) for k in range(0, len(rows), size)]
        got = [r for b in jj._shared_only(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [(t, n, 2 * n, 3 * n) for t, n in rows.tolist() if counts[t] > 1]


def test_keys_across_batches():
    rng = np.random.default_rng(2)
    rows = np.array(sorted(rng.integers(0, 20, (200, 2)).tolist()))
    want = {(n, rows[rows[:, 0] == t, 1].min()) for t, n in rows.tolist()}
    for size in (1, 2, 3, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + size, 0]), pa.array(rows[k : k + size, 1]), pa.nulls(len(rows[k : k + size]), pa.int64())], ["key", "node", "head"]) for k in range(0, len(rows), size)]
        got = {r for b in jj._key_edges(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == {(n, h) for n, h in want if n != h}


def test_components_of_hubs_and_chains(spark):
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1001 + k) for k in range(300)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7)], "a long, b long").repartition(6)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(301)}


def test_several_groups_across_batches(monkeypatch):
    rng = np.random.default_rng(3)
    rows = np.array(sorted(rng.integers(0, 40, (200, 2)).tolist()))
    rows[:, 1] %= 3
    groups = {t: {g for u, g in rows.tolist() if u == t} for t in rows[:, 0].tolist()}
    schema = ["token", "node", "rank", "size", "grp", "large"]
    for size in (1, 2, 3, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + size, c]) for c in (0, 1, 0, 0, 1, 1)], schema) for k in range(0, len(rows), size)]
        got = [r for b in jj._several_groups(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)]
        assert got == [(t, g) for t, g in rows.tolist() if len(groups[t]) > 1]
    monkeypatch.setattr(jj, "WAITING", 3)  # passes on more, never less
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + 2, c]) for c in (0, 1, 0, 0, 1, 1)], schema) for k in range(0, len(rows), 2)]
    got = {r for b in jj._several_groups(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)}
    assert got >= {(t, g) for t, g in rows.tolist() if len(groups[t]) > 1}


def test_threshold_is_exact_for_very_large_sets():
    shared = 1_700_000
    for total, linked in ((3_966_666, 1), (3_966_667, 0)):  # 7 * shared against 3 * total
        a = total // 2
        sizes = np.array([a, total - a])
        tokens = np.concatenate([np.arange(a), np.arange(a - shared, a - shared + total - a)])
        assert len(jj.open_unit(np.array([3, 3]), sizes, tokens, 75)[0]) == linked
