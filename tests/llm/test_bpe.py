"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strataview.llm import bpe
from strataview.llm.bpe import Vocabulary, decode, encode, encoded_digests
from tests.llm.cases import frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_library(library):
    with open(PATH, encoding="utf-8") as file:
        own = Vocabulary(file.read())
    rng = random.Random(3)
    pools = ["abc'sΣİé́ \n1", "the quick it's <|endoftext|>", None, "aab", " \x1c\x1f\x85  ab", "漢字かな가각", "ABCxyz'LL 've"]
    for k in range(6000):
        pool = rng.choice(pools)
        n = rng.randrange(0, 300 if k % 50 == 0 else 14)
        text = "".join(rng.choice(pool) if pool else chr(rng.choice([rng.randrange(0x800), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(n))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode([text]).to_pylist() == [ids], ascii(text)
        assert own.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [library.decode(ids, skip_special_tokens=False)]
    texts = ["ab" * 40_000, "é" * 5000, "x<|startoftext|>" * 900, "", "word " * 300_000, "more words here"]
    assert own.encode(texts).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in texts]
    for texts in ([f"{rng.getrandbits(90):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(5000)] for _ in range(50)):
        own.encode(texts)
        assert len(own.kept) <= bpe.KEPT
    assert own.encode(texts).to_pylist() == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_and_heap_agree():
    with open(PATH, encoding="utf-8") as file:
        own = Vocabulary(file.read())
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aabcethins") if rng.random() < 0.9 else rng.randrange(256) for _ in range(rng.randrange(1, 65))) for _ in range(3000)]
    ids, counts = own.merge(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own._heaped(w) for w in words]


def test_rows(spark, library):
    encoded = encode(frame(spark), PATH)
    assert encoded.count() == len(rows())
    for row in decode(encoded, PATH).collect():
        texts = [t or "" for k, t, *_ in rows() if k == row["doc_id"]]
        assert row["ids"] in [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert row["decoded"] == library.decode(row["ids"], skip_special_tokens=False)
    assert encoded_digests(frame(spark, []), PATH).collect() == []
    null = spark.createDataFrame([(1, None), (2, [49407, 999_999, 0])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in decode(null, PATH).collect()} == {1: "", 2: "<|endoftext|> !"}


def test_query(spark, library):
    from strataview.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {}
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[row["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_bpe"](spark, sf).collect()} == want


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError):
        encode(frame(spark), public_tokenizers.path("byte_bpe_50k.json"))
