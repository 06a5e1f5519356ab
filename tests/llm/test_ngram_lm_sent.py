import numpy as np
import pyarrow as pa
import pytest

from strataview.llm import ngram_lm as lm
from tests.llm.test_ngram_lm_memory import peak


def block(n, words):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, words) % 100_000) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array([True] * n), pa.array([7] * n, pa.int64())], ["doc_id", "text", "train", "block"])


def test_executors_hold_compressed_chunks_in_small_batches():
    batch, found, size = block(1500, 700), 0, 0
    for rows in lm._requests(3, 40)(iter([batch])):
        assert rows.nbytes < 2 * lm.SENT_BYTES
        found += sum(len(lm.decode(own)) for own in rows.column(3).to_pylist())
        size += sum(map(len, rows.column(2).to_pylist() + rows.column(3).to_pylist()))
    assert found > 500_000 and size < 9 * found  # 16 bytes a key and count before


def test_scoring_takes_few_times_a_block():
    batch = block(1500, 700)
    sent = {}
    for rows in lm._requests(3, 3)(iter([batch])):
        sent.update(zip(rows.column(0).to_pylist(), rows.column(3).to_pylist(), strict=True))
    answers = pa.table({"part": list(sent), "totals": pa.array(list(sent.values()), pa.binary())})
    texts = pa.table({"doc_id": batch.column(0), "text": batch.column(1)})
    scored, most = peak(lambda: lm._score(3, 3, 701 * 1500, 90_000, lm.STRENGTHS)(texts, answers))
    assert scored.num_rows == 1500 and most < 18 * sum(map(len, batch.column(1).to_pylist()))


@pytest.mark.parametrize("ranges", [1, 5, 8, 11, 217])
def test_bands_lose_no_key(ranges):
    batch = block(30, 100)
    tokens, owner = lm.tokens_of(batch)
    rows = [dict(zip(r, v, strict=True)) for b in lm._requests(3, ranges)(iter([batch.slice(0, 9), batch.slice(9)])) for r, v in [(b.schema.names, x) for x in zip(*b.to_pydict().values(), strict=True)]]
    assert len({r["part"] for r in rows}) == len(rows)
    for level in range(3):
        keys, at = lm.grams(tokens, owner, level + 1)
        found, times = np.unique(keys, return_counts=True)
        mine = sorted((r for r in rows if r["part"] // ranges == level), key=lambda r: r["part"])
        assert (np.concatenate([lm.decode_sorted(r["keys"]) for r in mine]) == found).all()
        assert (np.concatenate([lm.decode(r["own"]) for r in mine]) == times).all()
        arc, last = lm.Automaton.sort(keys, at, len(tokens))
        assert (keys[np.searchsorted(at, last)] == found).all() and (found[arc[at]] == keys).all() and (arc >= 0).sum() == len(at)
