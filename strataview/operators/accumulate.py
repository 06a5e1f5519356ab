"""Node states: everything a spec keeps of a node, filled by tasks in one scan of the facts and merged by node.

A task reads its facts in Arrow batches and holds a state for each node (path, class) that it meets: the count, sketch
registers, the bottom-k sample with exact counts and spans, both extremes with counts and spans, the dictionary and the histogram
of sizes.  A task returns its states as rows of a small table; any division of the facts into tasks, and of a task into several
states, gives the same spec after merging, since a value of the whole's bottom k is in the bottom k of every part that holds it.

What a state holds is bounded but for dictionaries, histograms, whole samples and the number of nodes; once a task has ``HELD`` such entries it
returns its states and starts anew.  A lost task is computed again from its input.

Extremes compare by an order-preserving binary key, ``number_key``: exact for integers, decimals of any scale and
doubles together.  Texts compare by their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.functions.hierarchy import RANK
from strataview.operators import merge as M
from strataview.operators.sketches import NODE, merge_registers
from strataview.sources.tables import small_batches

INTEGERS = ("0", "byte", "char", "non_neg_integer", "neg_integer")
NUMBERS = (*INTEGERS, "float", "decimal", "number", "integer")
TEXTS = ("binary", "<<>>", "atom", "boolean", "timestamp", "date")
HISTOGRAMS = ("binary", "<<>>", "nonempty_list", "improper_list")
DICTIONARIES = ("atom", "boolean")
#: Facts, and bytes of facts, that are handled at once, and entries after which a task returns its states.
AT_ONCE, BYTES, HELD = 60_000, 16 << 20, 200_000
NO_SPAN = (None, None)


def number_key(value: int | float | Decimal) -> bytes:
    """Bytes whose order is that of all numbers: -inf, negative, zero, positive, inf, nan."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return b"\x05" if value != value else b"\x04" if value > 0 else b"\x00"
    sign, digits, exponent = Decimal(value).as_tuple()
    while digits and digits[-1] == 0:
        digits, exponent = digits[:-1], exponent + 1
    if not digits:
        return b"\x02"
    # where the point stands, then the digits, each plus one so that the end is less than any
    body = (len(digits) + exponent + (1 << 31)).to_bytes(4, "big") + bytes(d + 1 for d in digits) + b"\x00"
    return b"\x01" + bytes(255 - x for x in body) if sign else b"\x03" + body


def rank_of(name: str) -> int:
    """Rank of a class's values among those of other kinds."""
    if name in NUMBERS:
        return RANK["number"]
    if name.startswith("#") or name.startswith("tuple"):
        return RANK["tuple"]
    if name in ("[]", "nonempty_list", "list", "improper_list"):
        return RANK["list"]
    return RANK.get("atom" if name == "boolean" else name, RANK["bitstring"])


def _part(value: Any) -> Any:
    """A value of a key or timestamp in a form that compares: fields of records in their order, nulls first."""
    if isinstance(value, dict):
        return tuple(_part(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_part(x) for x in value)
    return (value is not None, value if value is not None else 0)


def _first_order(span: tuple) -> tuple:
    ts, key = span
    return (0, _part(ts), _part(key)) if ts is not None else (1, _part(key)) if key is not None else (2,)


def _last_order(span: tuple) -> tuple:
    ts, key = span
    return (2, _part(ts), _part(key)) if ts is not None else (1, _part(key)) if key is not None else (0,)


class Spans:
    """First and last (ts, key) of groups of a batch's facts; a missing ts counts only where there is no other."""

    def __init__(self, ts: pa.Array, key: pa.Array):
        self.ts, self.key = ts, key
        self.on = ts.null_count < len(ts) or key.null_count < len(key)
        if not self.on:
            return
        try:
            table = pa.table({"ts": ts, "key": key})
            order = pc.sort_indices(table, sort_keys=[("ts", "ascending"), ("key", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
        except (pa.ArrowNotImplementedError, pa.ArrowTypeError, pa.ArrowInvalid, ValueError):
            pairs = [(_part(a), _part(b)) for a, b in zip(ts.to_pylist(), key.to_pylist(), strict=True)]
            order = np.array(sorted(range(len(pairs)), key=pairs.__getitem__), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.order, n = order, len(order)
        no_ts = pc.is_null(ts).to_numpy(zero_copy_only=False)
        no_key = pc.is_null(key).to_numpy(zero_copy_only=False)
        neither = no_ts & no_key
        self.last = np.where(neither, -1, place)
        self.first = np.where(neither, 4 * n, np.where(no_ts, place + n, place))

    def of(self, rows: np.ndarray, group: np.ndarray, n: int) -> list[tuple[tuple, tuple]]:
        if not self.on:
            return [(NO_SPAN, NO_SPAN)] * n
        size = len(self.order)
        first, last = np.full(n, 4 * size), np.full(n, -1)
        np.minimum.at(first, group, self.first[rows])
        np.maximum.at(last, group, self.last[rows])
        at_first = [self.order[f % size] if f < 4 * size else None for f in first.tolist()]
        at_last = [self.order[x] if x >= 0 else None for x in last.tolist()]
        value = lambda k: NO_SPAN if k is None else (self.ts[int(k)].as_py(), self.key[int(k)].as_py())
        return [(value(a), value(b)) for a, b in zip(at_first, at_last, strict=True)]


class Tally:
    """Count and span of one value."""

    __slots__ = ("first", "last", "n")

    def __init__(self, n: int, span: tuple[tuple, tuple]):
        self.n, (self.first, self.last) = n, span

    def add(self, n: int, span: tuple[tuple, tuple]) -> None:
        self.n += n
        self.first = min(self.first, span[0], key=_first_order)
        self.last = max(self.last, span[1], key=_last_order)

    def row(self, **values) -> dict:
        return {**values, "n": self.n, "first_ts": self.first[0], "first_key": self.first[1], "last_ts": self.last[0], "last_key": self.last[1]}


class State:
    """The state of one node."""

    def __init__(self, path: str, name: str, b: int | None, k: int | None, sampled: bool):
        self.path, self.name, self.k = path, name, k
        self.n = 0
        self.registers = np.zeros(1 << b, np.int8) if b else None
        self.sampled = sampled and not name.startswith("#") and name not in ("map", "null")
        self.samples: dict[tuple[int, str], Tally] = {}
        self.level: int | None = None
        self.ends: dict[str, tuple[bytes, int | None, float | None, str, Tally]] = {}
        self.dictionary: dict[str, Tally] = {}
        self.histogram: dict[int, int] = {}

    def entries(self) -> int:
        return 1 + len(self.samples) + len(self.dictionary) + len(self.histogram)

    def sample(self, h: np.ndarray, rows: np.ndarray, texts: pa.Array, spans: Spans) -> None:
        low = h >= 0 if self.level is None else (h >= 0) & (h <= self.level)
        rows, h = rows[low], h[low]
        if not len(rows):
            return
        hashes, group = np.unique(h, return_inverse=True)
        if self.k is not None and len(hashes) > self.k:
            low = group < self.k
            rows, group = rows[low], group[low]
        found = texts.take(pa.array(rows)).dictionary_encode()
        size = len(found.dictionary)
        pairs, where, back, counts = np.unique(group * size + found.indices.to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        names = found.dictionary.to_pylist()
        for pair, n, span in zip(pairs.tolist(), counts.tolist(), spans.of(rows, back, len(pairs)), strict=True):
            key = (int(hashes[pair // size]), names[pair % size])
            if key in self.samples:
                self.samples[key].add(n, span)
            else:
                self.samples[key] = Tally(n, span)
        if self.k is not None and len(self.samples) >= self.k:
            kept = sorted(self.samples)[: self.k]
            self.samples = {key: self.samples[key] for key in kept}
            self.level = kept[-1][0]

    def end(self, which: str, key: bytes, inum: int | None, num: float | None, text: str, n: int, span) -> None:
        old = self.ends.get(which)
        if old is not None and old[0] == key:
            old[4].add(n, span)
            self.ends[which] = (key, old[1], old[2], min(old[3], text), old[4])
        elif old is None or (key < old[0] if which == "min" else key > old[0]):
            self.ends[which] = (key, inum, num, text, Tally(n, span))

    def text_ends(self, rows: np.ndarray, texts: pa.Array, spans: Spans) -> None:
        own = texts.take(pa.array(rows))
        both = pc.min_max(own).as_py()
        for which in ("min", "max"):
            text = both[which]
            old = self.ends.get(which)
            if text is None or (old is not None and (text.encode() > old[0] if which == "min" else text.encode() < old[0])):
                continue
            same = rows[pc.equal(own, text).to_numpy(zero_copy_only=False)]
            self.end(which, text.encode(), None, None, text, len(same), spans.of(same, np.zeros(len(same), np.int64), 1)[0])

    def number_ends(self, rows: np.ndarray, num: np.ndarray, inum: np.ndarray, whole: np.ndarray, texts: pa.Array, spans: Spans) -> None:
        """Candidates equal as doubles are told apart exactly."""
        own = num[rows]
        nan = np.isnan(own)
        for which in ("min", "max"):
            if nan.all() or (which == "max" and nan.any()):
                near = rows[nan]
            else:
                near = rows[own == (np.nanmin(own) if which == "min" else np.nanmax(own))]
            if self.name == "float":
                values = {float(num[near[0]]): near}
            elif self.name in INTEGERS and whole[near].all():
                values = {int(v): near[inum[near] == v] for v in ((inum[near].min() if which == "min" else inum[near].max()),)}
            else:
                found = texts.take(pa.array(near)).dictionary_encode()
                codes = found.indices.to_numpy()
                exact = [Decimal(t) for t in found.dictionary.to_pylist()]
                best = min(exact) if which == "min" else max(exact)
                values = {best: near[np.isin(codes, [k for k, v in enumerate(exact) if v == best])]}
            for value, same in values.items():
                key = number_key(value)
                old = self.ends.get(which)
                if old is not None and (key > old[0] if which == "min" else key < old[0]):
                    continue
                text = pc.min(texts.take(pa.array(same))).as_py()
                known = int(inum[same[0]]) if whole[same[0]] else None
                self.end(which, key, known, float(num[same[0]]), text, len(same), spans.of(same, np.zeros(len(same), np.int64), 1)[0])

    def count_values(self, rows: np.ndarray, texts: pa.Array, spans: Spans) -> None:
        found = texts.take(pa.array(rows)).dictionary_encode()
        codes = found.indices.to_numpy()
        size = len(found.dictionary)
        for text, n, span in zip(found.dictionary.to_pylist(), np.bincount(codes, minlength=size).tolist(), spans.of(rows, codes, size), strict=True):
            if text in self.dictionary:
                self.dictionary[text].add(n, span)
            else:
                self.dictionary[text] = Tally(n, span)

    def count_sizes(self, sizes: np.ndarray) -> None:
        for size, n in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True):
            self.histogram[size] = self.histogram.get(size, 0) + n

    def row(self) -> dict:
        registers = None
        if self.registers is not None:
            registers = [{"idx": k, "rank": int(self.registers[k])} for k in np.flatnonzero(self.registers).tolist()]
        rank = rank_of(self.name)
        return {
            "path": self.path,
            "class": self.name,
            "n": self.n,
            "registers": registers,
            "samples": [t.row(vtext=text, h=h) for (h, text), t in self.samples.items()],
            "extremes": [t.row(which=which, rank=rank, ord=key, inum=inum, num=num, vtext=text) for which, (key, inum, num, text, t) in self.ends.items()],
            "dictionary": [t.row(vtext=text) for text, t in self.dictionary.items()],
            "histogram": [{"bucket": size, "n": n} for size, n in self.histogram.items()],
        }


def _filled(table: pa.Table, name: str, fill, kind) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def accumulate(table: pa.Table, states: dict[tuple[str, str], State], b: int | None, k: int | None, sampled: bool) -> None:
    """Add the facts of ``table`` to the states of their nodes."""
    paths, names = (table.column(c).combine_chunks().dictionary_encode() for c in ("path", "class"))
    width = len(names.dictionary)
    code = paths.indices.to_numpy().astype(np.int64) * width + names.indices.to_numpy()
    nodes, group = np.unique(code, return_inverse=True)
    order = np.argsort(group.astype(np.int32), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(nodes) + 1))
    texts = table.column("vtext").combine_chunks()
    h, sizes = _filled(table, "h", -1, np.int64), _filled(table, "len", -1, np.int64)
    num = _filled(table, "num", float("nan"), np.float64)
    inum, whole = _filled(table, "inum", 0, np.int64), pc.is_valid(table.column("inum").combine_chunks()).to_numpy(zero_copy_only=False)
    spans = Spans(table.column("__ts").combine_chunks(), table.column("__key").combine_chunks())
    if b:
        bits = 32 - b
        index = h >> bits
        rank = (bits + 1 - np.frexp((h & ((1 << bits) - 1)).astype(np.float64))[1]).astype(np.int8)
    for node, low, high in zip(nodes.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        path, name = paths.dictionary[node // width].as_py(), names.dictionary[node % width].as_py()
        state = states.get((path, name))
        if state is None:
            state = states[path, name] = State(path, name, b, k, sampled)
        rows = order[low:high]
        state.n += len(rows)
        own = h[rows]
        if state.registers is not None:
            there = own >= 0
            np.maximum.at(state.registers, index[rows[there]], rank[rows[there]])
        if state.sampled:
            state.sample(own, rows, texts, spans)
        if name in NUMBERS:
            state.number_ends(rows, num, inum, whole, texts, spans)
        elif name in TEXTS:
            state.text_ends(rows, texts, spans)
        if name in DICTIONARIES:
            state.count_values(rows, texts, spans)
        if name in HISTOGRAMS:
            state.count_sizes(sizes[rows][sizes[rows] >= 0])


def in_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in halves of halves, until each is within ``BYTES`` or a single fact."""
    if batch.nbytes <= BYTES or batch.num_rows <= 1:
        yield batch
        return
    middle = batch.num_rows // 2
    yield from in_bytes(batch.slice(0, middle))
    yield from in_bytes(batch.slice(middle))


def node_states(facts: DataFrame, b: int | None, k: int | None, sampled: bool = True, count=None) -> DataFrame:
    """States of the nodes of ``facts``, one or more for each task and node; ``count``: an accumulator of records."""
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    span = f"n:bigint,first_ts:{kinds['__ts']},first_key:{kinds['__key']},last_ts:{kinds['__ts']},last_key:{kinds['__key']}"
    ddl = (
        "path string, class string, n bigint, registers array<struct<idx:int,rank:int>>, "
        f"samples array<struct<vtext:string,h:bigint,{span}>>, extremes array<struct<which:string,rank:int,ord:binary,inum:bigint,num:double,vtext:string,{span}>>, "
        f"dictionary array<struct<vtext:string,{span}>>, histogram array<struct<bucket:bigint,n:bigint>>"
    )

    def schema(ts: pa.DataType, key: pa.DataType) -> pa.Schema:
        tail = [("n", pa.int64()), ("first_ts", ts), ("first_key", key), ("last_ts", ts), ("last_key", key)]
        listed = lambda *fields: pa.list_(pa.struct([*fields]))
        ends = [("which", pa.string()), ("rank", pa.int32()), ("ord", pa.binary()), ("inum", pa.int64()), ("num", pa.float64()), ("vtext", pa.string())]
        return pa.schema([
            ("path", pa.string()), ("class", pa.string()), ("n", pa.int64()), ("registers", listed(("idx", pa.int32()), ("rank", pa.int32()))),
            ("samples", listed(("vtext", pa.string()), ("h", pa.int64()), *tail)), ("extremes", listed(*ends, *tail)),
            ("dictionary", listed(("vtext", pa.string()), *tail)), ("histogram", listed(("bucket", pa.int64()), ("n", pa.int64()))),
        ])

    def add(batches: list[pa.RecordBatch], states: dict[tuple[str, str], State]) -> None:
        table = pa.Table.from_batches(batches)
        accumulate(table, states, b, k, sampled)
        if count is not None:
            count.add(pc.sum(pc.equal(table.column("path"), "$")).as_py())  # a record has one fact at the root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, str], State] = {}
        waiting: list[pa.RecordBatch] = []
        held = 0
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [s.row() for s in states.values()]
            states.clear()
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 1000], kind)

        for batch in (part for whole in batches for part in in_bytes(whole)):
            kind = kind or schema(batch.schema.field("__ts").type, batch.schema.field("__key").type)
            waiting.append(batch)
            held += batch.nbytes
            if held >= BYTES or sum(x.num_rows for x in waiting) >= AT_ONCE:
                add(waiting, states)
                waiting, held = [], 0
                if sum(s.entries() for s in states.values()) > HELD:
                    yield from flush()
        if waiting:
            add(waiting, states)
        yield from flush()

    small_batches(facts.sparkSession)
    return facts.select("path", "class", "vtext", "inum", "num", "len", "h", "__ts", "__key").mapInArrow(run, ddl)


def merged_tables(states: DataFrame, b: int | None, k: int | None, sampled: bool = True) -> dict[str, DataFrame | None]:
    """The tables of a spec from node states."""

    def parts(name: str) -> DataFrame:
        return states.select(*NODE, F.inline(name))

    return {
        "nodes": M.merge_nodes(states),
        "registers": merge_registers(parts("registers")) if b else None,
        "samples": M.merge_sample_table(parts("samples"), k) if sampled else None,
        "extremes": M.merge_extremes(parts("extremes")),
        "dictionary": M.merge_dictionary(parts("dictionary")),
        "histogram": M.merge_histogram(parts("histogram")),
    }
