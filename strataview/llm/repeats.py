"""Removal of long repeated byte strings (at least ``LENGTH`` bytes), and passages that documents share.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Beside
that, sequences of ``PASSAGE`` words (lower-cased, white space apart) that another document holds
too are reported and not removed.  Both are one search over windows of symbols, bytes or words.
Windows are compared where equal ones must meet: every window has
an *anchor*, its least gram (by hash, leftmost), and equal windows have equal
anchors at equal distances.  Consecutive windows with one anchor make a *run*.

1. One row per run goes by anchor.  Runs that are identical as a whole count as
   one variant; a variant that occurs twice (words: in two documents) is covered wherever it occurs.
2. Where an anchor has several variants, one representative of each sends its symbols,
   and their windows are compared by distance from the anchor.  Anchors of more than
   ``HOT`` variants never meet in a task: their windows are counted by hash, row by row.
3. Covered ranges are united per document and cut out.

Runs are the same if the 64-bit hashes of anchor and content, the length and the place of the anchor agree.
``bwt.py`` holds the merge of shard Burrows-Wheeler transforms; the README gives its
measured cost and says why this way is the one that runs.

Defined cases: a null text is an empty one; texts shorter than a window lose nothing; rows
that repeat are occurrences of each other for removal, and one document for passages; matches never
cross documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import release, stage
from strataview.llm.textkit import byte_symbols, mix, powers, steps, symbol_sums, text_buffers, word_hashes

#: Bytes of a window and its grams; words of a passage and its grams.
LENGTH, GRAM = 400, 32
PASSAGE, PASSAGE_GRAM = 51, 8
BYTES, WORDS = 0, 1
#: Variants of an anchor that are compared in one task.
HOT = 20_000
#: Windows that are hashed, and compared, at a time.
STEP_WINDOWS = 1 << 18
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_POSITION_BITS = 24


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width) + 1
    padded = np.full(blocks * width, _TOP)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def find_runs(symbols: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows: text number, first window, windows, anchor distance, anchor, content hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(symbols) < length:
        return none
    sums = symbol_sums(symbols)
    at = np.arange(len(symbols) - gram + 1)
    grams = window_hashes(sums, at, at + gram)
    # the least gram of a window, leftmost: hash above, position below
    packed = ((grams >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS)) | at.astype(np.uint64)
    least = sliding_min(packed, length - gram + 1) & np.uint64((1 << _POSITION_BITS) - 1)
    start = np.arange(len(least))
    owner = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[owner + 1]
    start, owner, least = start[inside], owner[inside], least[inside].astype(np.int64)
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    begin, whose, anchor = start[first], owner[first], least[first]
    content = window_hashes(sums, begin, begin + n - 1 + length)
    return whose, begin - offsets[whose], n, anchor - begin, grams[anchor].view(np.int64), content.view(np.int64)


def long_runs(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``find_runs`` with very long texts in overlapping pieces."""
    most = 1 << (_POSITION_BITS - 1)
    if len(symbols) <= most:
        yield find_runs(symbols, offsets, length, gram)
        return
    for row in range(len(offsets) - 1):
        text = symbols[offsets[row] : offsets[row + 1]]
        for at in range(0, max(1, len(text) - length + 1), most):
            piece = text[at : at + most + length - 1]
            whose, first, *rest = find_runs(piece, np.array([0, len(piece)]), length, gram)
            yield (whose + row, first + at, *rest)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin and the last end."""
    hashes, owner = word_hashes(data, offsets)
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


RUN = "row long, first int, n int, gap int, anchor long, content long"
SHARED = "kind int, n int, gap int, anchor long, content long, low int, high int"
PIECE = "kind int, n int, gap int, anchor long, content long, least long, most long, symbols binary"
WINDOW = "kind int, n int, gap int, anchor long, content long, least long, most long, step int, value long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in steps(whole):
            rows = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for kind, (symbols, at), length, gram in ((BYTES, (byte_symbols(data), offsets), LENGTH, GRAM), (WORDS, word_symbols(data, offsets), PASSAGE, PASSAGE_GRAM)):
                for whose, first, n, gap, anchor, content in long_runs(symbols, at, length, gram):
                    # anchors of the two kinds never meet: the lowest bit is the kind
                    yield _batch(RUN, [rows[whose], first, n, gap, (anchor & ~1) | kind, content])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of the asked runs of each text: bytes, or hashes of words."""
    for whole in batches:
        for batch in steps(whole):
            data, offsets = text_buffers(batch.column(0))
            words, at = word_symbols(data, offsets)
            out: list[list] = [[] for _ in range(8)]
            for k, asked in enumerate(batch.column(1).to_pylist()):
                text, its_words = data[offsets[k] : offsets[k + 1]], words[at[k] : at[k + 1]]
                for x in asked:
                    kind = x["anchor"] & 1
                    for column, value in zip(out, (kind, x["n"], x["gap"], x["anchor"], x["content"], x["least"], x["most"]), strict=False):
                        column.append(value)
                    source, length = (its_words, PASSAGE) if kind else (text, LENGTH)
                    out[7].append(source[x["first"] : x["first"] + x["n"] - 1 + length].tobytes())
            yield _batch(PIECE, out)


def _values(kind: int, n: np.ndarray, gap: np.ndarray, anchor: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window (run after run) with its distance from the anchor, and its place in the run."""
    data, offsets = text_buffers(column)
    symbols, length = (np.frombuffer(data.tobytes(), np.uint64), PASSAGE) if kind else (byte_symbols(data), LENGTH)
    begin = offsets[:-1] // (8 if kind else 1)
    step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = np.repeat(begin, n) + step
    value = window_hashes(symbol_sums(symbols), at, at + length)
    return mix(value + mix((np.repeat(anchor, n) + np.repeat(gap, n) - step).astype(np.uint64))), step


def shared_windows(value: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Windows whose value has more than one origin, from the least and the greatest origin of each."""
    own, back = np.unique(value, return_inverse=True)
    low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
    np.minimum.at(low, back, least)
    np.maximum.at(high, back, most)
    return (low != high)[back]


def shared_flags(kind: int, n: np.ndarray, gap: np.ndarray, anchor: np.ndarray, column: pa.Array, least: np.ndarray, most: np.ndarray, limit: int = STEP_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the given runs are shared, and their places in the run.

    Hashes are made for some runs at a time, and compared for a part of the range of hashes at a time:
    beside about 20 bytes a window, memory is bounded by ``limit`` windows.
    """
    ends = np.cumsum(n)
    value, step = np.empty(int(ends[-1]), np.uint64), np.empty(int(ends[-1]), np.int32)
    at = 0
    while at < len(n):
        low = int(ends[at - 1]) if at else 0
        end = max(int(np.searchsorted(ends, low + limit, "right")), at + 1)
        value[low : ends[end - 1]], step[low : ends[end - 1]] = _values(kind, n[at:end], gap[at:end], anchor[at:end], column.slice(at, end - at))
        at = end
    which = np.repeat(np.arange(len(n), dtype=np.int32), n)
    parts = len(value) // limit + 1
    part = (value % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    flags = np.zeros(len(value), bool)
    for k in range(parts):
        own = np.flatnonzero(part == k)
        flags[own] = shared_windows(value[own], least[which[own]], most[which[own]])
    return flags, step


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared window ranges of the variants of each anchor; rows are sorted by anchor."""
    waiting: list[pa.RecordBatch] = []

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for kind in (BYTES, WORDS):
            own = rows.filter(pa.array(rows.column(0).to_numpy() == kind))
            n, gap, anchor, content, least, most = (own.column(k).to_numpy() for k in range(1, 7))
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # whole anchors, a few MB of symbols at a time
                end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_WINDOWS, "right"))
                end = min(max(end, at + 1), len(n))
                end = at + int(np.searchsorted(anchor[at:], anchor[end - 1], "right"))
                part = slice(at, end)
                # bytes: any two variants; words: variants of two documents
                origin = (np.arange(at, end),) * 2 if kind == BYTES else (least[part], most[part])
                flags, step = shared_flags(kind, n[part], gap[part], anchor[part], own.column(7).slice(at, end - at), *origin)
                begins = flags & ((step == 0) | ~np.concatenate([[False], flags[:-1]]))
                stops = flags & (np.concatenate([step[1:] == 0, [True]]) | ~np.concatenate([flags[1:], [False]]))
                b, e = np.flatnonzero(begins), np.flatnonzero(stops)
                row = at + np.searchsorted(ends[part] - (ends[at - 1] if at else 0), b, "right")
                yield _batch(SHARED, [np.full(len(row), kind), n[row], gap[row], anchor[row], content[row], step[b], step[e]])
                at = end

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column(3).to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
        if cut or (waiting and waiting[-1].column(3)[-1].as_py() != anchors[-1]):
            waiting.append(batch.slice(0, cut))
            yield from compare(joined())
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from compare(joined())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of the given pieces."""
    for batch in batches:
        for kind in (BYTES, WORDS):
            own = batch.filter(pa.array(batch.column(0).to_numpy() == kind))
            for at in range(0, own.num_rows, 500):
                part = own.slice(at, 500)
                columns = [c.to_numpy() for c in part.columns[:7]]
                value, step = _values(kind, *columns[1:4], part.column(7))
                yield _batch(WINDOW, [*(np.repeat(c, columns[1]) for c in columns), step, value.view(np.int64)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the covered ranges out of each text; ranges of words are counted."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
    for whole in batches:
        for batch in steps(whole):
            data, offsets = text_buffers(batch.column(1))
            out: list[list] = [[] for _ in range(6)]
            for k, ranges in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                spans, passages = (merge_ranges([(r["low"], r["high"]) for r in ranges or () if r["kind"] == kind]) for kind in (BYTES, WORDS))
                kept, at = hashlib.sha256(), 0
                for low, high in spans:
                    kept.update(text[at:low].tobytes())
                    at = high
                kept.update(text[at:].tobytes())
                found = (len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), len(passages), sum(b - a for a, b in passages))
                for column, value in zip(out, found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words.

    The last two: maximal word sequences of which every ``PASSAGE`` words occur in another document, and their words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    variant = ["anchor", "gap", "n", "content"]
    is_words = F.col("anchor").bitwiseAND(F.lit(1).cast("long")) == WORDS
    length = F.when(is_words, PASSAGE).otherwise(LENGTH)
    # a text of fewer bytes than words and blanks of a passage has no window at all
    every = stage(texts.where(F.octet_length("text") >= min(LENGTH, 2 * PASSAGE - 1)).select("row", "text").mapInArrow(_runs, RUN), "runs")
    # most anchors are alone; partial aggregation makes a hot passage one row per task
    met = stage(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    runs = stage(every.join(met, "anchor", "left_semi"), "shared-runs")
    release(every)
    known = stage(runs.groupBy(*variant).agg(F.count("*").alias("times"), F.min(F.struct("row", "first")).alias("at"), F.max("row").alias("most")), "variants")
    anchors = stage(known.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1"), "anchors")
    run = F.struct(F.col("at.first").alias("first"), *variant, F.col("at.row").alias("least"), "most", (F.col("variants") > HOT).alias("hot")).alias("run")
    asked = known.join(anchors, "anchor").select(F.col("at.row").alias("row"), run)
    asked = asked.groupBy("row").agg(F.collect_list("run").alias("runs"))  # at most a text's own runs
    one = texts.select("row", "text").join(asked, "row")

    def pieces(hot: bool) -> DataFrame:
        chosen = F.filter("runs", lambda r: r["hot"] if hot else ~r["hot"])
        return one.select("text", chosen.alias("runs")).where(F.size("runs") > 0).mapInArrow(_pieces, PIECE)

    shared = stage(pieces(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, SHARED), "shared")
    if anchors.where(F.col("variants") > HOT).limit(1).count():
        windows = stage(pieces(True).mapInArrow(_windows, WINDOW), "windows")
        origin = lambda name: F.when(is_words, F.col(name)).otherwise(F.xxhash64(*variant))
        values = windows.groupBy("value", "kind").agg(F.min(origin("least")).alias("lo"), F.max(origin("most")).alias("hi")).where("lo <> hi").select("value", "kind")
        found = windows.join(values, ["value", "kind"]).select("kind", "n", "gap", "anchor", "content", F.col("step").alias("low"), F.col("step").alias("high"))
        shared = shared.unionByName(found)
    # whole runs that are covered, and the covered windows of others: one join
    repeated = known.where(F.when(is_words, F.col("at.row") != F.col("most")).otherwise(F.col("times") > 1)).select(*variant, F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
    covered = runs.join(repeated.unionByName(shared.drop("kind")), variant)
    covered = covered.select("row", F.struct(F.when(is_words, WORDS).otherwise(BYTES).alias("kind"), (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + length).alias("high")).alias("range"))
    ranges = covered.groupBy("row").agg(F.collect_set("range").alias("ranges"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"
    return texts.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, out)
