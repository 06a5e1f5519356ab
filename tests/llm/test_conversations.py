"""Conversation repair against enumeration of all edits, and in pieces against whole conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataview.llm import conversations as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("seg", T.StringType()), T.StructField("key", T.StringType())])
WELL = re.compile(r"(s?(ua)+)?")


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        out.append(C.first_fault(text, (role, text) in seen))
        seen.add((role, text))
    return out


def enumerated(turns):
    """(cost, audit, repaired) of the best of all edits with at most two insertions in a gap."""
    options = []
    for (role, text), fault in zip(turns, faults(turns), strict=True):
        extra = 3 if fault == "truncated" else 0
        moves = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            moves += [("K", extra, [(role, text)]), *(("R", 3 + extra, [(r, text)]) for r in ("user", "assistant"))]
        options.append(moves)
    inserts = [("I" * n, 3 * n, [(r, "") for r in roles]) for n in range(3) for roles in product(("user", "assistant"), repeat=n)]
    best = None
    for gaps in product(inserts, repeat=len(turns) + 1):
        for edits in product(*options):
            steps = [gaps[0]]
            for edit, gap in zip(edits, gaps[1:], strict=True):
                steps += [edit, gap]
            roles = [x for s in steps for x in s[2]]
            initials = "".join(r[:1] or "?" for r, _ in roles)
            if WELL.fullmatch(initials):
                found = (sum(s[1] for s in steps), "".join(s[0] for s in steps), "\n".join(f"{r}:{t}" for r, t in roles))
                best = found if best is None else min(best, found)
    return best


def chained(turns):
    """The same by dynamic programming over audit strings."""
    layer = {("", False): (0, "", ())}
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def put(out, key, entry):
        if key not in out or entry < out[key]:
            out[key] = entry

    for (role, text), fault in [*zip(turns, faults(turns), strict=True), (("", ""), "end")]:
        for _ in range(2):
            for (state, _), (cost, audit, said) in list(layer.items()):
                step = after[state][-1]
                put(layer, (step, True), (cost + 3, audit + "I", (*said, (name[step], ""))))
        if fault == "end":
            break
        out = {}
        for (state, _), (cost, audit, said) in layer.items():
            put(out, (state, state != ""), (cost + 4, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            if role[:1] and role[:1] in after[state]:
                put(out, (role[:1], True), (cost + extra, audit + "K", (*said, (role, text))))
            step = after[state][-1]
            put(out, (step, True), (cost + extra + 3, audit + "R", (*said, (name[step], text))))
        layer = out
    cost, audit, said = min(v for (state, _), v in layer.items() if state in ("", "a"))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in said)


def expected(rows):
    """Report by conversation of (conv_id, turn, role, text) rows after damage."""
    import xxhash

    by = {}
    for row in rows:
        by.setdefault(row[0], [])
        if len(row) > 1:
            by[row[0]].append(row[1:])
    out = {}
    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], signed(r[2])))
        said = [r[1:] for r in turns]
        numbers = [r[0] for r in turns if r[0] is not None]
        found = faults(said)
        cost, audit, repaired = chained(said)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        row = (conv, turn, "user" if hit == 4 else role, text)
        out += [(conv,)] if hit == 0 else [row, row] if hit == 3 else [row]
    return out


def found(frame):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in frame.collect()}


def random_rows(rng, convs, turns):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "a", "s"]
    texts = ["Yes.", "No!", "Well, a", "", " \t", None, "Yes.", "Ünd so?", "long " * 50 + "."]
    out = []
    for conv in convs:
        for t in range(turns(conv)):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 5])
            role = ["user", "assistant"][t % 2] if rng.random() < 0.6 else rng.choice(roles)
            out.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.6 else f"Turn {t}."))
    return out


def test_edits_match_enumeration():
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "No", "", "Yes."]
    for _ in range(150):
        turns = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(3))]
        assert chained(turns) == enumerated(turns)
    for _ in range(400):
        turns = [(rng.choice(roles), rng.choice(texts + [str(k)])) for k in range(rng.randrange(12))]
        rows = [{"turn": k, "role": r, "text": t, "fault": f} for k, ((r, t), f) in enumerate(zip(turns, faults(turns), strict=True))]
        got = C.solved(1, 0, 0, rows, 0, None, None)
        assert (got["cost"], got["audit"], "\n".join(f"{t['role']}:{t['text']}" for t in got["turns"])) == chained(turns)


@pytest.mark.parametrize("cut", [2048, 3])
def test_reports_match(spark, cut):
    rng = random.Random(7 + cut)
    rows = random_rows(rng, [None, *range(40)], lambda c: 300 if c in (3, None) else rng.randrange(1, 9))
    rows += rows[:20]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    pieces = C.repair(C.damage(frame), F.col("gone"), cut)
    assert found(C.reports(pieces)) == expected(damaged(rows))
    if cut == 3:
        assert pieces.where("not whole").count() > 50


def test_hot_conversation_spans_tasks(spark):
    """A conversation of a third of all rows, many of them alike and without a number, lies in several tasks."""
    rng = random.Random(3)
    hot = [(5, None if k % 3 == 0 else k, ["user", "assistant"][k % 2], "Same." if k % 3 == 0 else f"Turn {k % 700}.") for k in range(3000)]
    rows = hot + random_rows(rng, range(10, 1200), lambda c: 5)
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = C.repair(C.damage(frame), F.col("gone"))
        assert pieces.where("conv_id = 5").select("part").distinct().count() > 1
        assert found(C.reports(pieces)) == expected(damaged(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_gone_and_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.reports(C.repair(empty)).collect() == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "user", "Gone.")]
    pieces = C.repair(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), F.col("conv_id") == 2)
    turns = {(r["conv_id"], r["nth"]): (r["role"], r["text"], r["origin"]) for r in C.repaired_turns(pieces).collect()}
    assert turns == {(1, 0): ("user", "Hi.", 0), (1, 1): ("assistant", "Again.", 1)}
    assert found(C.reports(pieces))[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query(spark):
    from strataview.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_conversations"](spark, sf)) == expected(damaged(rows))
