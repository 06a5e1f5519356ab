import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd

from strataview.llm import mixing, pii, secrets, staging, warc
from strataview.llm.exact_dedup import exact_dedup
from tests.llm import cases


def records(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_brute_force(spark):
    data = cases.rows() * 3
    got = sorted(tuple(r.values()) for r in records(exact_dedup(cases.frame(spark, data).repartition(7))))
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    want = []
    for doc_id, text, *_ in data:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[norm])[1]
        want.append((doc_id, keep, len(groups[norm]), keep == doc_id, sha(norm)))
    assert got == sorted(want)
    assert records(exact_dedup(cases.frame(spark, []))) == []


def base_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def noisy(rng, pieces, n):
    return "".join(rng.choice(pieces) for _ in range(n))


def test_pii_equals_patterns_on_noise(spark):
    rng = random.Random(3)
    pieces = ["a", "é", "@", ".", "-", "+", "1", "23", "4111 1111 1111 1111", "10.0.0.1", "256", " ", "(", ")", "x@y.zz", "+49 170 1234567", "\n", "\U0001f600", "٣", "%"]
    texts = [noisy(rng, pieces, 60) for _ in range(800)]
    for text in texts:
        assert [s for s in pii.find_spans(text) if s[1] in pii.BASE] == base_pii(text), text
    data = [(k, t, "en", "a", 0, "", "", "") for k, t in enumerate(texts[:50])] + cases.rows()
    got = {r["doc_id"]: r for r in records(pii.find_pii(cases.frame(spark, data[:50])))}
    assert got[7]["base_sha256"] == sha(pii.span_text(base_pii(texts[7])))
    assert len(records(pii.find_pii(cases.frame(spark)))) == len(cases.rows())
    assert records(pii.find_pii(cases.frame(spark, []))) == []


def test_pii_extra_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no 12345678 and ftp://bob:pw@host/"
    assert {s[1] for s in pii.find_spans(text)} >= {"iban", "account", "userinfo"}
    assert not [s for s in pii.find_spans("iban DE00370400440532013000 account none") if s[1] in pii.EXTRA]


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_equal_patterns(spark):
    rng = random.Random(4)
    pieces = ["token", "Secret", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH01", "deadbeef", "0123456789abcdef", "é", "\U0001f600", "x.y", "/+", "\n", "password=hunter22", "a"]
    texts = [noisy(rng, pieces, 40) for _ in range(300)]
    data = [(k, t, "en", "a", 0, "", "", "") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in records(secrets.scan_secrets(cases.frame(spark, data)))}
    for k, text in enumerate(texts):
        want = base_secrets(text)
        assert got[k]["base_sha256"] == sha(want), text
        assert got[k]["n_assign"] + got[k]["n_access"] + got[k]["n_hex"] == len([x for x in want.split(",") if x])
        assert set(filter(None, want.split(","))) <= set(got[k]["spans"].split(","))
    assert len(records(secrets.scan_secrets(cases.frame(spark)))) == len(cases.rows())
    assert records(secrets.scan_secrets(cases.frame(spark, []))) == []


def test_randomness_battery(spark):
    rng = np.random.default_rng(1)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    random_tokens = ["x " + "".join(rng.choice(alphabet, 64)) + " y" for _ in range(40)]
    plain = ["x " + "the-quick-brown-fox-jumps-over-the-lazy-dog-1" * 2 + " y" for _ in range(40)]
    data = [(k, t, "en", "a", 0, "", "", "") for k, t in enumerate(random_tokens + plain)]
    got = {r["doc_id"]: "random:" in r["spans"] for r in records(secrets.scan_secrets(cases.frame(spark, data)))}
    assert sum(got[k] for k in range(40)) >= 34
    assert not any(got[k] for k in range(40, 80))


def test_every_candidate_is_tested(spark):
    parts = [
        ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKEY"),
        ("STRIPE_SK=", "sk9fQ2LmX8vT4bNc7RzKpWd1HgYs"),
        ("id ", "Zk3+vQ9_xT1/mW7-pL5bR2dHs8Yc"),
        ("id ", "x7Kq9mT2vLp4ZrW8sBn3"),
        ("id ", "Qm7xT2vLp4ZrW8sBn3Kd5A=="),
        ("NAME_OF_A_LONG_SETTING_1=", "Hq7xT2vLp4ZrW8sBn3Kd5A"),
        ("KEY=", "vT8kQm2LxZ5rWb7NpY=="),
        ("id ", "vT8kQm2LxZ5rWb7NpY="),  # too short
    ]
    data = [(k, f"set {a}{b} end", "en", "a", 0, "", "", "") for k, (a, b) in enumerate(parts)]
    got = {r["doc_id"]: r["spans"].split(",") for r in records(secrets.scan_secrets(cases.frame(spark, data)))}
    for k, (a, b) in enumerate(parts):
        begin = 4 + len(a)
        assert (f"random:{begin}:{begin + len(b)}" in got[k]) == (len(b) >= 20), (b, got[k])


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ b", "same"), (2, "http://b", "same"), (5, None, None), (4, "u", ""), (3, "u\r\nX: y", "é" * 100_000), (9, "z", "same")]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = {r["page_id"]: r for r in records(warc.round_trip(frame))}
    first = {}
    for page_id, _, html in sorted(pages):
        raw = (html or "").encode()
        at = first.setdefault(raw, page_id)
        assert got[page_id]["payload_bytes"] == len(raw)
        assert got[page_id]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[page_id]["refers_to"] == (None if at == page_id else at)
        assert got[page_id]["record_type"] == ("response" if at == page_id else "revisit")
    assert len(got) == len(pages)
    assert records(warc.round_trip(frame.limit(0))) == []


def test_coalesced_reads():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (100, 5)], gap=20) == [(0, 15, [0, 1]), (100, 105, [2])]


def test_mixing_meets_margins(spark):
    rng = random.Random(2)
    data = [(k, "w " * rng.randint(1, 50), rng.choice(["en", "en", "de"]), rng.choice("aaab"), 0, "", "", "") for k in range(4000)]
    given = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    out = mixing.mix_sources(cases.frame(spark, data), given).toPandas()
    expected = out.n_tokens * out.probability
    assert abs(expected.sum() / out.n_tokens.sum() - 0.5) < 0.01
    assert abs(expected[out.source == "b"].sum() / expected.sum() - 0.4) < 0.01
    assert abs(expected[out.lang == "de"].sum() / expected.sum() - 0.5) < 0.01
    kept = out[out.kept]
    assert abs(kept.n_tokens.sum() / expected.sum() - 1) < 0.06
    spread = mixing.mix_sources(cases.frame(spark, data), given, max_cells=0, rounds=6).toPandas()
    local = mixing.mix_sources(cases.frame(spark, data), given, rounds=6).toPandas()
    both = spread.merge(local, on="doc_id")
    assert np.allclose(both.probability_x, both.probability_y)


def test_mixing_edge_cases(spark):
    got = mixing.mix_sources(cases.frame(spark)).toPandas()
    assert len(got) == len(cases.rows()) and got.probability.between(0, 1).all()
    assert mixing.mix_sources(cases.frame(spark, [])).count() == 0


def test_rake_converges():
    cells = pd.DataFrame({"source": ["a", "a", "b"], "lang": ["x", "y", "y"], "topic": ["t"] * 3, "tokens": [100, 100, 100]})
    want = mixing.rake(cells, {"source": pd.Series({"a": 0.5, "b": 0.5}), "lang": pd.Series({"x": 0.25, "y": 0.75})}, 100)
    assert np.allclose([want[:2].sum(), want[2], want[0]], [50, 50, 25], atol=1e-3)


def test_arrow_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, then in (("64m", str(staging.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(key, given)
            staging.small_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
