import shutil

import pyarrow as pa
from pyspark.sql import functions as F

from strataview.operators import accumulate
from strataview.operators.sketches import register_rank
from strataview.plans import terms
from strataview.plans.options import make_options
from strataview.plans.profile import profile, states_of


def test_a_profile_reads_its_input_once(spark, tmp_path):
    """The tables of a spec do not go back to the input, which may be gone."""
    path = str(tmp_path / "rows")
    spark.range(1000).withColumn("t", F.col("id") % 7).write.parquet(path)
    spec = profile(spark.read.parquet(path), 0, limit=None, name="r")
    shutil.rmtree(path)
    assert {(r["path"], r["class"]): r["n"] for r in spec.postproc().nodes.collect()}["$.t", "byte"] == 1000
    assert spec.samples.where("path = '$.t'").count() == 7


def test_facts_are_held_by_bytes():
    """Long texts are handled in parts of bounded bytes, one that is longer alone; none is lost."""
    texts = ["x" * (1 << 20)] * 70 + ["y" * (20 << 20)] + ["z"] * 9
    parts = list(accumulate.in_bytes(pa.RecordBatch.from_pydict({"vtext": texts})))
    assert all(p.nbytes <= accumulate.BYTES or p.num_rows == 1 for p in parts)
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts


def test_no_hashes_without_sketch_and_sample(spark):
    rows = spark.range(5).withColumn("t", F.col("id").cast("string"))
    plan = states_of(rows, 0, make_options(limit=None, samples=None, hll_b=None))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan


def test_register_ranks_without_texts(spark):
    h = [0, 1, 2, 3, 255, 256, (1 << 27) - 1, 1 << 27, (1 << 28) - 1, 1 << 28, (1 << 32) - 1]
    for b in (4, 8, 16):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in h], "h long").select(register_rank(F.col("h"), b)).collect()]
        assert got == [32 - b + 1 - (x & ((1 << (32 - b)) - 1)).bit_length() for x in h]
    assert "bin(" not in str(register_rank(F.col("h"), 4))


def test_terms_are_folded_many_parts_at_once(spark, monkeypatch):
    """Node states are filled by one job for many parts, not for each part."""
    filled = []
    real = terms.states_of
    monkeypatch.setattr(terms, "states_of", lambda *given: filled.append(1) or real(*given))
    found = terms.TermSpec(spark, at_once=5)
    for k in range(40):
        found.add({"a": k % 3}, key=f"k{k}")
    assert not filled
    assert {(r["path"], r["class"]): r["n"] for r in found.spec().nodes.collect()} == {("$", "map"): 40, ("$.a", "0"): 14, ("$.a", "byte"): 26}
    assert len(filled) == 1
