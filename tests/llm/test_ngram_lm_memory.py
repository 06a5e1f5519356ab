import tracemalloc

import numpy as np
import pyarrow as pa

from strataview.llm import ngram_lm as lm


def peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_takes_few_times_its_text():
    rng, n = np.random.default_rng(4), 1500
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 700) % 100_000) for _ in range(n)]
    size = sum(map(len, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array([True] * n), pa.array([7] * n, pa.int64())], ["doc_id", "text", "train", "block"])
    list(lm._requests(3, 3)(iter([batch.slice(0, 2)])))  # tables of powers
    sent = {}

    def ask():
        for rows in lm._requests(3, 3)(iter([batch])):
            sent.update(zip(rows.column(0).to_pylist(), rows.column(3).to_pylist(), strict=True))

    assert peak(ask)[1] < 20 * size  # with the rows kept here
    own = {p: lm.decode(v) for p, v in sent.items()}
    assert [int(sum(v.sum() for p, v in own.items() if p // 3 == level)) for level in range(3)] == [701 * n, 700 * n, 699 * n]
    answers = pa.table({"part": list(sent), "totals": pa.array(list(sent.values()), pa.binary())})
    scored, most = peak(lambda: lm._score(3, 3, 701 * n, 90_000, lm.STRENGTHS)(pa.table({"doc_id": batch.column(0), "text": batch.column(1)}), answers))
    assert scored.num_rows == n and most < 30 * size
