"""Node states: order of the number key, and specs that do not depend on how facts are divided."""

import datetime
import math
import random
import time
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataview.operators import accumulate as A
from strataview.plans.background import Probe, hashable
from strataview.plans.profile import profile
from strataview.plans.terms import TermSpec, text_of


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_number_key_orders_all_numbers():
    rng = random.Random(1)
    numbers = [0, 1, -1, 10, 9, 255, 256, -256, 10**37, 10**37 + 1, -(10**37), Decimal("1e-18"), Decimal("1.000000000000000001"), Decimal("1.00"), 0.1, Decimal("0.1"), 1e300, -1e-300, 5e-324]
    numbers += [rng.randrange(-(10**6), 10**6) for _ in range(100)] + [Decimal(rng.randrange(-(10**9), 10**9)).scaleb(-rng.randrange(20)) for _ in range(200)] + [rng.gauss(0, 10 ** rng.randrange(-5, 9)) for _ in range(200)]
    exact = lambda v: Decimal(v)
    keyed = sorted(numbers, key=A.number_key)
    assert [exact(v) for v in keyed] == sorted(map(exact, numbers))
    assert A.number_key(1) == A.number_key(1.0) == A.number_key(Decimal("1.000")) and A.number_key(0.0) == A.number_key(-0.0)
    ends = [A.number_key(v) for v in (-math.inf, -1e308, -5e-324, 0, 5e-324, 1e308, math.inf, math.nan)]
    assert ends == sorted(ends) and len(set(ends)) == 8


def table(facts):
    names = ["path", "class", "vtext", "inum", "num", "len", "h", "__ts", "__key"]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.date32(), pa.int64()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*facts, strict=True), kinds, strict=True)})


def random_facts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        v = rng.choice([rng.randrange(1, 9), rng.randrange(1, 200)])
        span = rng.choice([None, datetime.date(2020, 1, rng.randrange(1, 28))]), rng.choice([None, rng.randrange(9)])
        name = rng.choice(["byte", "float", "decimal", "binary", "boolean", "null", "map"])
        text = {"byte": str(v), "float": str(v / 2), "decimal": f"{v % 3}.00000000000000000{v % 10}", "binary": f"t{v}", "boolean": str(v % 2)}.get(name)
        num = None if text is None or name in ("binary", "boolean") else float(text)
        out.append((f"$.{v % 2}", name, text, v if name == "byte" else None, num, 8 * len(text) if name == "binary" else None, None if text is None else (v * 2654435761) % 2**32, *span))
    return out


def naive(facts, k):
    """States by plain loops."""
    groups = {}
    for f in facts:
        groups.setdefault((f[0], f[1]), []).append(f)
    out = {}
    for (path, name), own in groups.items():
        def tally(chosen):
            spans = [(f[7], f[8]) for f in chosen]
            timed = [s for s in spans if s[0] is not None] or [s for s in spans if s[1] is not None]
            order = lambda s: (str(s[0]), -1 if s[1] is None else s[1])
            return (len(chosen), min(timed, key=order), max(timed, key=order)) if timed else (len(chosen), (None, None), (None, None))

        values = {}
        for f in own:
            if f[2] is not None:
                values.setdefault((f[6], f[2]), []).append(f)
        number = name in ("byte", "float", "decimal")
        ends = {}
        if number or name in ("binary", "boolean"):
            key = (lambda t: Decimal(t)) if number else (lambda t: t)
            for which, pick in (("min", min), ("max", max)):
                best = pick(key(f[2]) for f in own)
                same = [f for f in own if key(f[2]) == best]
                ends[which] = (min(f[2] for f in same), *tally(same))
        out[path, name] = (
            len(own), {t: tally(v) for t, v in sorted(values.items())[:k]} if name not in ("null", "map") else {}, ends,
            {f[2]: tally([x for x in own if x[2] == f[2]]) for f in own} if name == "boolean" else {},
            {s: sum(f[5] == s for f in own) for s in {f[5] for f in own}} if name == "binary" else {},
        )
    return out


def seen(states):
    t = lambda x: (x.n, x.first, x.last)
    return {key: (s.n, {k: t(v) for k, v in s.samples.items()}, {w: (e[3], *t(e[4])) for w, e in s.ends.items()}, {k: t(v) for k, v in s.dictionary.items()}, s.histogram) for key, s in states.items()}


def test_states_equal_plain_loops():
    for seed in range(5):
        facts = random_facts(1500, seed)
        for step in (1500, 97, 1):
            states = {}
            for at in range(0, len(facts) if step > 1 else 60, step):
                A.accumulate(table(facts[at : at + step]), states, 8, 5, True)
            assert seen(states) == naive(facts if step > 1 else facts[:60], 5), (seed, step)


def test_registers():
    facts = random_facts(3000, 9)
    states = {}
    A.accumulate(table(facts), states, 8, 5, True)
    for key, state in states.items():
        want = np.zeros(256, int)
        for f in facts:
            if (f[0], f[1]) == key and f[6] is not None:
                low = f[6] & (2**24 - 1)
                want[f[6] >> 24] = max(want[f[6] >> 24], 25 - low.bit_length())
        assert (state.registers == want).all()


def test_spans_of_nested_attributes():
    ts = pa.array([{"d": 3, "e": None}, None, {"d": 1, "e": "x"}, {"d": 1, "e": None}], pa.struct([("d", pa.int64()), ("e", pa.string())]))
    spans = A.Spans(ts, pa.array([1, 2, 3, 4]))
    first, last = spans.of(np.arange(4), np.zeros(4, np.int64), 1)[0]
    assert first == ({"d": 1, "e": None}, 4) and last == ({"d": 3, "e": None}, 1)


def test_input_is_read_once(spark):
    """All tables of a spec, and its cardinalities, come from one pass over the input."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.range(5000).selectExpr("id", "id % 7 as small", "concat('t', id % 900) as txt", "id % 2 = 0 as flag").mapInPandas(counted, "id long, small long, txt string, flag boolean")
    spec = profile(df, (0, {"ts": "small", "key": "id"}), limit=None, name="r")
    for part in spec.tables().values():
        part.collect()
    assert read.value == 5000
    plans = " ".join(part._jdf.queryExecution().executedPlan().toString() for part in spec.tables().values())
    assert "BroadcastExchange" not in plans


def test_tasks_return_states_when_they_hold_much(spark):
    """Dictionaries and map keys without bound: states are returned in between, and the spec is the same."""
    df = spark.range(150_000).selectExpr("concat('w', id % 70000) as word", "map(concat('k', id % 1500), id % 5) as m").coalesce(2)
    spec = profile(df, 0, limit=None, name="r", categorical=("$.word",), hll_b=None)
    counts = spec.dictionary.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    assert tuple(counts) == (70000, 150_000, 3)
    assert spec.nodes.where("path like '$.m.%'").select("path").distinct().count() == 1500
    assert spec.nodes.where("path like '$.m.%'").agg(F.sum("n")).first()[0] == 150_000


def test_background_parts_of_nested_maps(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "struct(map('a', id) as m) as s", "array(map('b', id)) as l")
    assert [hashable(f.dataType) for f in df.schema.fields] == [True, False, False]
    spec = Probe(df, 0, output_path=f"{tmp_path}/bg", parts=2, limit=None, name="r").wait(120)
    assert rows(spec.nodes) == rows(profile(df, 0, limit=None, name="r").nodes)


def test_progress_reports_rising_counts(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(0.4)
            yield batch

    seen = []
    df = spark.range(0, 4000, 1, 12).selectExpr("id", "id % 3 as x").mapInPandas(slow, "id long, x long")
    spec = profile(df, 0, limit=None, name="r", progress=1, report=lambda records, seconds: seen.append((records, seconds)))
    assert seen[-1][0] == 4000 and len(seen) >= 2 and seen == sorted(seen) and seen[0][0] < 4000
    assert spec.nodes.where("path = '$'").first()["n"] == 4000


def test_terms_added_one_by_one(spark):
    rng = random.Random(4)
    terms = [rng.choice([None, True, k, k / 4, f"t{k % 9}", [k % 3, ["x", None]], {"a": k % 5, "b": {"c": [k % 2]}}, [], (1, 2)]) for k in range(200)]
    added = TermSpec(spark, "ts date, key long", at_once=60, name="r", variant_depth=None)
    for k, term in enumerate(terms[:150]):
        added.add(term, datetime.date(2020, 1, 1 + k % 20), k)
    assert added.spec().nodes.where("path = '$'").agg(F.sum("n")).first()[0] == 150
    for k, term in enumerate(terms[150:], 150):
        added.add(term, datetime.date(2020, 1, 1 + k % 20), k)
    got = added.spec()
    data = [(text_of(t), datetime.date(2020, 1, 1 + k % 20), k) for k, t in enumerate(terms)]
    want = profile(spark.createDataFrame(data, "term string, ts date, key long").withColumn("term", F.parse_json("term")), ("term", {"ts": "ts", "key": "key"}), limit=None, name="r")
    for table in ("nodes", "registers", "samples", "dictionary", "histogram", "extremes"):
        columns = getattr(want, table).columns
        assert rows(getattr(got, table).select(*columns)) == rows(getattr(want, table)), table
    counts = {(r["path"], r["class"]): r["n"] for r in got.nodes.collect()}
    assert counts["$", "float"] == sum(isinstance(t, float) for t in terms)
    assert got.meta["processed"] == 200 and TermSpec(spark).spec().nodes.count() == 0
