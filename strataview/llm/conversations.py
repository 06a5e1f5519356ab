"""Repair of the structure of conversations by the cheapest edits.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``.  Its turns are kept (free), get the role of
user or assistant (3), or are deleted (4; blank turns and repetitions must be); turns of user or assistant without text are
inserted anywhere (3); a truncated turn that is not deleted costs 3 more.  Of the cheapest edits those whose initials (D, I, K, R)
are least in order are made.

Rank-compressed dynamic programming.  A layer follows each turn and holds, for each last role, the least cost.  A step
is a macro edit: up to two inserted turns, then the turn's own edit.  The codes of macro edits, ``CODES``, are prefix-free
and numbered in order, so of two audits of one layer neither begins the other, and audits compare as (audit up to the layer before, code).
A layer therefore keeps the rank of each audit among its own and a parent pointer instead of the audit; audits and turns are made
afterwards along the pointers.

Scale: turns are sorted by range over (conversation, turn), so a conversation of any size lies in several
tasks, each of which streams its turns.  Conversations that end inside a task and have at most ``CUT`` turns are solved there.
Others are left as pieces of at most ``CUT`` turns.  A piece is reduced to costs and ranks from each of four states to each;
since these compose like matrices, one streaming pass over a conversation's pieces (four bytes a piece are held) fixes the states between them,
and every piece is then solved alone, wherever it is.  Repetitions across pieces are found by a grouped minimum over digests.  Only the
digest of a whole repaired conversation, a sequential hash, reads its pieces one after another in one task, in bounded memory.

Defined cases: null roles and texts are one space; null conversation ids are one conversation; null turns come first; turns of
one number go by role, then by a hash of the text; turns with an initial other than s, u or a, or with an empty role, cannot be kept; a
conversation whose turns are all ``gone``, or are all deleted, is empty; repeated rows are repetitions; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import stage
from strataview.llm.textkit import thrifty

#: Turns and text characters of a piece.
CUT, CUT_CHARS = 2048, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
USER, ASSISTANT = "user", "assistant"
#: States are the initial of the last role so far; the first stands for none.
STATES = ("", "s", "u", "a")
#: What may follow a state.
FOLLOW = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Turns that a conversation needs after its last state.
ENDING = {0: 0, 1: 2, 2: 1, 3: 0}
#: Codes of macro edits in order; none begins another.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
CODE = {c: k for k, c in enumerate(CODES)}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
NEVER = 1 << 60

Vector = list[tuple[int, int]]


def _inserted(state: int, n: int) -> int:
    """State after ``n`` inserted turns."""
    for _ in range(n):
        state = FOLLOW[state][-1]
    return state


def _macros(initial: str, truncated: bool, forced: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code): the best macro edit between each two states for a kind of turn."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    extra = 3 if truncated else 0
    for p in range(4):
        for n in range(3):
            at = _inserted(p, n)
            moves = [("D", at, COST["D"])]
            if not forced:
                moves += [("K", q, extra) for q in FOLLOW[at] if STATES[q] == initial]
                moves.append(("R", FOLLOW[at][-1], COST["R"] + extra))
            for edit, q, cost in moves:
                entry = (cost + n * COST["I"], CODE["I" * n + edit])
                best[p, q] = min(best.get((p, q), entry), entry)
    return [(p, q, *entry) for (p, q), entry in sorted(best.items())]


#: Macro edits by (initial, truncated, must be deleted).
MACROS = {(i, t, f): _macros(i, t, f) for i in ("s", "u", "a", "?") for t in (False, True) for f in (False, True)}


def start(entry: int) -> Vector:
    return [(0, 0) if q == entry else (NEVER, 0) for q in range(4)]


def forward(kinds: list[tuple], layer: Vector) -> tuple[Vector, list[bytes]]:
    """The layer (cost, rank of the audit) after all turns, and for every turn the parent pointer and code of each state."""
    pointers = []
    for kind in kinds:
        best: list[tuple | None] = [None] * 4
        for p, q, cost, code in MACROS[kind]:
            if layer[p][0] < NEVER:
                entry = (layer[p][0] + cost, layer[p][1], code, p)
                if best[q] is None or entry < best[q]:
                    best[q] = entry
        order = sorted(x[1:3] for x in best if x is not None)
        layer = [(x[0], order.index(x[1:3])) if x is not None else (NEVER, 0) for x in best]
        pointers.append(bytes(v for x in best for v in ((x[3], x[2]) if x is not None else (0, 0))))
    return layer, pointers


def backward(pointers: list[bytes], state: int) -> list[str]:
    """Codes of the macro edits that lead to ``state``."""
    codes = []
    for row in reversed(pointers):
        codes.append(CODES[row[2 * state + 1]])
        state = row[2 * state]
    return codes[::-1]


def finish(layer: Vector) -> int:
    """The last state of the cheapest whole audit, then the least; what is left to insert depends on it alone."""
    return min((cost + COST["I"] * ENDING[q], rank, q) for q, (cost, rank) in enumerate(layer) if cost < NEVER)[2]


def compose(layer: Vector, piece: list[Vector]) -> tuple[Vector, bytes]:
    """The layer after a piece (a vector for each entry state), and each state's entry."""
    best: list[tuple | None] = [None] * 4
    for p, (cost, rank) in enumerate(layer):
        for q, (more, inner) in enumerate(piece[p]):
            if cost < NEVER and more < NEVER:
                entry = (cost + more, rank, inner, p)
                if best[q] is None or entry < best[q]:
                    best[q] = entry
    order = sorted(x[1:3] for x in best if x is not None)
    layer = [(x[0], order.index(x[1:3])) if x is not None else (NEVER, 0) for x in best]
    return layer, bytes(x[3] if x is not None else 0 for x in best)


def edited(turns: list[dict], codes: list[str], entry: int, tail: int) -> list[dict]:
    """The repaired turns; ``origin`` is the turn's number, null for an inserted one."""
    out, state = [], entry

    def insert(n: int) -> None:
        nonlocal state
        for _ in range(n):
            state = FOLLOW[state][-1]
            out.append({"role": USER if STATES[state] == "u" else ASSISTANT, "text": "", "origin": None})

    for turn, code in zip(turns, codes, strict=True):
        insert(len(code) - 1)
        role = turn["role"]
        if code[-1] == "R":
            state = FOLLOW[state][-1]
            role = USER if STATES[state] == "u" else ASSISTANT
        elif code[-1] == "K":
            state = STATES.index(role[:1])
        if code[-1] != "D":
            out.append({"role": role, "text": turn["text"], "origin": turn["turn"]})
    insert(tail)
    return out


def kind_of(turn: dict) -> tuple:
    initial = turn["role"][:1]
    return initial if initial in ("s", "u", "a") else "?", turn["fault"] == "truncated", turn["fault"] in ("blank", "duplicate")


def first_fault(text: str, repeated: bool) -> str:
    words = text.rstrip(SPACE)
    if not words.strip(SPACE):
        return "blank"
    if repeated:
        return "duplicate"
    return "truncated" if words[-1] not in ".!?" else ""


def described(conv, part: int, seg: int, turns: list[dict]) -> dict:
    """Counts of a piece."""
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    initials = [t["role"][:1] for t in turns]
    return {
        "conv_id": conv, "part": part, "seg": seg, "n_turns": len(turns), "first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None), "numbers": len(set(numbers)),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0] if turns else None, "last": initials[-1] if turns else None,
        **{f: sum(t["fault"] == f for t in turns) for f in ("blank", "duplicate", "truncated")},
    }


def solved(conv, part: int, seg: int, turns: list[dict], entry: int, leave: int | None, tail: int | None) -> dict:
    """A piece with its audit and repaired turns; without ``leave`` it is a whole conversation."""
    layer, pointers = forward([kind_of(t) for t in turns], start(entry))
    if leave is None:
        leave = finish(layer)
        tail = ENDING[leave]
    codes = backward(pointers, leave)
    cost = layer[leave][0] + COST["I"] * tail
    return described(conv, part, seg, turns) | {"cost": cost, "audit": "".join(codes) + "I" * tail, "turns": edited(turns, codes, entry, tail)}


TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("origin", pa.int64())])
RAW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("key", pa.binary())])
COUNTS = [
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("numbers", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
]
SOLVED = pa.schema([*COUNTS, ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(TURN))])
SORTED = pa.schema([*SOLVED, ("raw", pa.list_(RAW))])
DDL = (
    "conv_id long, part int, seg long, n_turns long, first_turn long, last_turn long, numbers long, illegal long, first string, last string, blank long, duplicate long, truncated long, "
    "cost long, audit string, turns array<struct<role:string,text:string,origin:long>>"
)
RAW_DDL = "raw array<struct<turn:long,role:string,text:string,fault:string,key:binary>>"


def _packed(rows: Iterator[dict], schema: pa.Schema, size: int = 256, chars: int = CUT_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(t["text"]) for t in row.get("turns") or row.get("raw") or ())
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[dict]:
    """Sorted turns of one task: solved conversations, and unsolved pieces of those that may go on elsewhere or are long."""
    part = seg = 0
    held: list[dict] = []
    keys: set[bytes] = set()
    weight, conv, any_yet, open_end = 0, None, False, True

    def flush(whole: bool) -> dict:
        nonlocal seg, held, weight, keys
        seg += 1
        if whole:
            row = solved(conv, part, seg, held, 0, None, None)
        else:
            row = described(conv, part, seg, held) | {"raw": held}
        held, weight, keys = [], 0, set()
        return row

    for batch in batches:
        for row in batch.to_pylist():
            part = row["part"]
            if any_yet and row["conv_id"] != conv:
                yield flush(not open_end)
                open_end = False
            elif len(held) >= cut or weight >= CUT_CHARS:
                open_end = True
                yield flush(False)
            any_yet, conv = True, row["conv_id"]
            if row["gone"]:
                continue
            role, text = row["role"], row["text"]
            key = hashlib.blake2b(f"{conv}:{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            held.append({"turn": row["turn"], "role": role, "text": text, "fault": first_fault(text, key in keys), "key": key})
            keys.add(key)
            weight += len(text)
    if any_yet:
        yield flush(False)


def _judged(row: dict) -> list[dict]:
    """The turns of a piece, those held by an earlier piece marked as repetitions."""
    seen = set(row["seen"] or ())
    for turn in row["raw"]:
        if turn["key"] in seen and turn["fault"] != "blank":
            turn["fault"] = "duplicate"
    return row["raw"]


SUMMARY = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            kinds = [kind_of(t) for t in _judged(row)]
            flat = [entry for p in range(4) for entry in forward(kinds, start(p))[0]]
            out.append({"conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "costs": [c for c, _ in flat], "ranks": [r for _, r in flat]})
        yield pa.RecordBatch.from_pylist(out, SUMMARY)


BETWEEN = pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("tail", pa.int32())])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each piece; pieces come sorted by conversation, part and segment."""
    conv, any_yet = None, False
    layer, entries, parts, segs = start(0), bytearray(), array("i"), array("q")

    def flush() -> Iterator[pa.RecordBatch]:
        state = finish(layer)
        tail = ENDING[state]
        out = []
        for k in range(len(parts) - 1, -1, -1):
            before = entries[4 * k + state]
            out.append({"part": parts[k], "seg": segs[k], "entry": before, "leave": state, "tail": tail})
            state, tail = before, 0
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, BETWEEN)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, BETWEEN)

    for batch in batches:
        for row in batch.to_pylist():
            if any_yet and row["conv_id"] != conv:
                yield from flush()
                layer, entries, parts, segs = start(0), bytearray(), array("i"), array("q")
            any_yet, conv = True, row["conv_id"]
            flat = list(zip(row["costs"], row["ranks"], strict=True))
            layer, entry = compose(layer, [flat[4 * p : 4 * p + 4] for p in range(4)])
            entries += entry
            parts.append(row["part"])
            segs.append(row["seg"])
    if any_yet:
        yield from flush()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return _packed((solved(r["conv_id"], r["part"], r["seg"], _judged(r), r["entry"], r["leave"], r["tail"]) for r in rows), SOLVED)


def repair(conversations: DataFrame, gone: Column | None = None, cut: int = CUT) -> DataFrame:
    """Pieces of repaired conversations: conv_id, part, seg (their order), counts, cost, audit, ``turns`` (role, text, origin) and
    whether the piece is a whole conversation.

    ``conversations`` has conv_id, turn, role, text.  Rows where ``gone`` holds are no turns, but their conversation is returned.
    A piece has at most ``cut`` turns.
    """
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    text = F.when(gone, "").otherwise(F.coalesce(F.col("text"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), gone.alias("gone"))
    # equal turns of one number are dealt by a salt, as any order of them is the same
    order = ["conv_id", "turn", "role", "tie", "salt"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", F.spark_partition_id().alias("part"))
    pieces = stage(rows.mapInArrow(thrifty(lambda batches: _packed(_pieces(batches, cut), SORTED)), f"{DDL}, {RAW_DDL}"), "conversations")
    done, left = pieces.where("raw is null").drop("raw"), pieces.where("raw is not null")

    keys = left.select("part", "seg", F.explode(F.array_distinct("raw.key")).alias("key"))
    first = keys.groupBy("key").agg(F.min(F.struct("part", "seg")).alias("first"), F.count("*").alias("times")).where("times > 1")
    seen = keys.join(first.select("key", "first"), "key").where(F.struct("part", "seg") > F.col("first")).groupBy("part", "seg").agg(F.collect_list("key").alias("seen"))
    narrow = F.transform("raw", lambda t: F.struct(t["role"].alias("role"), t["fault"].alias("fault"), t["key"].alias("key"))).alias("raw")
    seen = stage(seen, "repetitions")
    known = left.join(seen, ["part", "seg"], "left")
    summaries = known.select("conv_id", "part", "seg", narrow, "seen").mapInArrow(thrifty(_summaries), "conv_id long, part int, seg long, costs array<long>, ranks array<int>")
    between = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(thrifty(_between), "part int, seg long, entry int, leave int, tail int")
    rest = known.join(stage(between, "between"), ["part", "seg"]).select("conv_id", "part", "seg", "raw", "seen", "entry", "leave", "tail")
    return done.withColumn("whole", F.lit(True)).unionByName(rest.mapInArrow(thrifty(_solve), DDL).withColumn("whole", F.lit(False)))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seg, nth, role, text, origin) of all turns; part, seg and nth give their order."""
    return pieces.select("conv_id", "part", "seg", F.posexplode("turns").alias("nth", "turn")).select("conv_id", "part", "seg", "nth", "turn.*")


REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPORT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """A conversation's report, made of its pieces in their order."""

    def __init__(self, conv):
        self.row = dict.fromkeys(REPORT.names, 0) | {"conv_id": conv}
        self.audit: list[str] = []
        self.sha, self.any_turn = hashlib.sha256(), False
        self.low = self.high = self.last = None
        self.numbers = 0

    def add(self, piece: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
            self.row[name] += piece[name]
        if piece["n_turns"]:
            if self.last is not None and self.last + piece["first"] not in ("su", "ua", "au"):
                self.row["illegal"] += 1
            self.last = piece["last"]
        if piece["first_turn"] is not None:
            self.numbers += piece["numbers"] - (self.high == piece["first_turn"])
            self.low, self.high = piece["first_turn"] if self.low is None else self.low, piece["last_turn"]
        self.audit.append(piece["audit"])
        for turn in piece["turns"]:
            self.sha.update((("\n" if self.any_turn else "") + f"{turn['role']}:{turn['text']}").encode())
            self.any_turn = True

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return self.row | {"gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if now is None or piece["conv_id"] != now.row["conv_id"]:
                if now is not None:
                    out.append(now.report())
                now = _Conversation(piece["conv_id"])
            now.add(piece)
        if out:
            yield pa.RecordBatch.from_pylist(out, REPORT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.report()], REPORT)


def reports(pieces: DataFrame) -> DataFrame:
    """Per conversation its gaps, faults, cost, audit and the digest of its repaired text."""
    parts = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return pieces.where("whole").mapInArrow(thrifty(_reports), REPORT_DDL).unionByName(parts.mapInArrow(thrifty(_reports), REPORT_DDL))


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged turns, by crc32 of ``conv_id:turn`` modulo 20, and a column ``gone`` for those that are dropped."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("hit"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")
