"""Awkward documents that every operator must take."""

import random

from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("keep_id", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("score", T.StringType())]
)


def rows():
    rng = random.Random(5)
    words = [f"w{k}é" for k in range(60)] + ["Alpha", "beta", "Gamma"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = text(120), text(20_000)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, base, base.replace(" ", "\n"), base.upper(), " ".join(near), "", None, " \t\n", "one", "one", "One two", long, long + " tail", text(5), text(4), "\U0001f600 " * 9, text(40), base + " " + text(3)]
    out = [(k, t, ["en", "de", None][k % 3], ["a", "a", None, "b"][k % 4], len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    return [*out, out[0], out[5]]  # repeated rows


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC)
