"""The randomness battery against plain numpy, its rate control against Benjamini-Hochberg, and long inputs."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from strataview.llm import secrets
from tests.llm import cases


def plain_p_values(token, alphabet):
    n, k = len(token), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    counts = np.array([token.count(c) for c in alphabet])
    chi, df = ((counts - n / k) ** 2).sum() / (n / k), k - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    ranks = np.array([alphabet.index(c) + 1 for c in token], float)
    up = ranks > (k + 1) / 2
    high, runs = up.sum(), 1 + (up[1:] != up[:-1]).sum()
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = abs(runs - mean) / math.sqrt(spread) if spread > 0 else 40
    d = ranks - ranks.mean()
    z_serial = abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() > 1e-6 else 40
    return {"chi": tail(z), "runs": 2 * tail(z_runs), "serial": 2 * tail(z_serial)}


def test_p_values_equal_numpy(spark):
    rng = np.random.default_rng(3)
    alphabets = [letters for _, letters in secrets.ALPHABETS]
    rows = []
    for k in range(120):
        letters = alphabets[k % len(alphabets)]
        some = list(letters)[: int(rng.integers(1, len(letters) + 1))] if k % 3 == 0 else list(letters)
        rows.append(("".join(rng.choice(some, int(rng.integers(20, 200)))), letters))
    df = spark.createDataFrame(rows, "token string, alphabet string")
    df = df.withColumn("s", secrets.sums(F.col("token"), F.col("alphabet"))).withColumn("q", secrets.letter_squares(F.col("token"), F.col("alphabet")))
    p = secrets.p_values(F.length("token").cast("double"), F.length("alphabet").cast("double"), F.col("q"), F.col("s"))
    for row in df.select("token", "alphabet", *(v.alias(k) for k, v in p.items())).collect():
        for name, want in plain_p_values(row.token, row.alphabet).items():
            assert abs(row[name] - want) < 1e-5, (row, name, want)


def test_rate_control_equals_benjamini_hochberg(spark):
    """Per length band, on p-values rounded up to the ends of their bins."""
    rng = np.random.default_rng(4)
    letters = secrets.ALPHABETS[3][1]
    tokens = []
    for k in range(150):
        n = int(rng.choice([22, 30, 60]))
        own = letters if k % 2 else letters[: int(rng.integers(8, 40))]
        tokens.append("a1" + "".join(rng.choice(list(own), n - 2)))
    got = {r.doc_id: "random:" in r.spans for r in secrets.scan_secrets(cases.frame(spark, [(k, f"x {t} y", "en", "a", 0, "", "", "") for k, t in enumerate(tokens)])).collect()}
    bands: dict[int, list] = {}
    for k, t in enumerate(tokens):
        alphabet = next(letters for pattern, letters in secrets.ALPHABETS if all(c in letters for c in t))
        p = min(1.0, 3 * min(plain_p_values(t, alphabet).values()))
        rounded = 10 ** (-secrets.BIN_WIDTH * min(secrets.MAX_BIN, math.floor(-math.log10(max(p, 1e-300)) / secrets.BIN_WIDTH)))
        band = next((i for i, top in enumerate(secrets.BANDS) if len(t) <= top), len(secrets.BANDS))
        bands.setdefault(band, []).append((rounded, k))
    want = {}
    for rows in bands.values():
        rows.sort()
        cut = max((i for i, (p, _) in enumerate(rows, 1) if p <= 0.05 * i / len(rows)), default=0)
        want |= {k: i > cut for i, (_, k) in enumerate(rows, 1)}
    assert len(bands) == 3 and 20 < sum(want.values()) < 130
    assert got == want


def test_long_token_and_many_matches(spark):
    rng = np.random.default_rng(5)
    token = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000))
    many = " ".join("token=" + "".join(rng.choice(list("ghij0"), 9)) + " é" for _ in range(3000))
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan_secrets(cases.frame(spark, [(1, token, "en", "a", 0, "", "", ""), (2, many, "en", "a", 0, "", "", "")])).collect()}
    assert time.time() - began < 60
    assert got[1].spans.split(",")[-1].endswith(":1000000") or "random:0:1000000" in got[1].spans
    assert got[2].n_assign == 3000
    spans = [x.split(":") for x in got[2].spans.split(",")]
    assert all(many[int(a) : int(b)].startswith("token=") and int(b) - int(a) == 15 for kind, a, b in spans if kind == "assign")
