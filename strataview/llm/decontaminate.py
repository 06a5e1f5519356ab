"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by a benchmark item of m bytes if some region of it is
within ``floor(edit_share * m)`` edits of the whole item.  Such a region and the item
share at least ``m - q + 1 - q * k`` q-grams on at most ``k + 1`` neighbouring diagonals; an item for which
that is no bound gets shorter q-grams, ``q = m // (k + 1)``.  Diagonals are
therefore cut into bands of ``2 * (k + 1)`` that overlap by half; only bands with enough shared
q-grams are retained, and banded alignment verifies each.

Letters A-Z count as lower case and every white-space character as a blank; items of fewer than
``LEAST`` bytes are no evidence and are not searched (``least=1`` searches all).  Q-grams that very many item positions
share are not looked up; the bound of an item falls by the number it loses, so no
region is lost.  An item that would lose all of its bound keeps its q-grams.

The index of the items is broadcast in blocks of at most ``BLOCK_BYTES`` of item text; a larger
benchmark takes several passes.

Defined cases: a null text or item is an empty one; repeated items are searched once and reported
under each of their ids; rows that repeat are each reported; an empty table gives an empty result; other
columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.textkit import mix, powers, range_sums, steps, text_buffers, thrifty

Q, EDIT_SHARE, LEAST = 10, 0.08, 24
#: A q-gram at more item positions than this is not looked up, if the bound allows.
COMMON = 12
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32

HIT = "doc_id long, item_id long, start int, end int, distance int, budget int, shared int"


def edit_budget(size, edit_share: float):
    return np.floor(np.asarray(size) * edit_share).astype(np.int64)


def indexes(items: list[tuple[list[int], bytes]], q: int, edit_share: float) -> list[Index]:
    """Indexes of a block of items, one for each length of q-grams that they need."""
    parts: dict[int, list] = {}
    for ids, text in items:
        parts.setdefault(max(1, min(q, len(text) // (int(edit_budget(len(text), edit_share)) + 1))), []).append((ids, text))
    return [Index(part, size, edit_share) for size, part in sorted(parts.items())]


class Index:
    """Q-grams of items; for each of them the lemma asks for one shared q-gram at least."""

    def __init__(self, items: list[tuple[list[int], bytes]], q: int = Q, edit_share: float = EDIT_SHARE):
        self.ids = [i for i, _ in items]
        self.texts = [np.frombuffer(t, np.uint8) for _, t in items]
        self.q = q
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = edit_budget(self.size, edit_share)
        self.need = self.size - q + 1 - q * self.budget
        item = np.repeat(np.arange(len(items)), self.size - q + 1) if len(items) else np.zeros(0, np.int64)
        grams = [grams_of(t, q) for t in self.texts]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        _, back, times = np.unique(gram, return_inverse=True, return_counts=True)
        common = times[back] > COMMON
        lost = np.bincount(item, common, len(items)).astype(np.int64)
        spared = self.need - lost < np.maximum(self.need // 2, 1)  # keeps all its q-grams
        common &= ~spared[item]
        self.need = self.need - np.where(spared, 0, lost)
        gram, item, place = gram[~common], item[~common], place[~common]
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.width = self.budget + 1
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True


def grams_of(data: np.ndarray, q: int) -> np.ndarray:
    if len(data) < q:
        return np.zeros(0, np.uint64)
    sums = range_sums(data)
    return mix((sums[q:] - sums[:-q]) * powers(len(sums))[1][: len(data) - q + 1])


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int]:
    """Least edits of ``item`` against a part of ``region``, and that part; paths stay on diagonals low..high.

    Diagonal: place in the region minus place in the item.  Returns (budget + 1, 0, 0) if more.
    """
    width = high - low + 1
    far = np.int64(1 << 40)
    diag = np.arange(width) + low
    # costs carry the start in their low bits: cost * 2**20 + start
    scale = np.int64(1 << 24)
    row = np.where((diag >= 0) & (diag <= len(region)), diag.astype(np.int64), far)
    step = np.arange(width, dtype=np.int64) * scale
    for i, c in enumerate(item.tolist()):
        at = diag + i  # place in the region that the diagonal step reads
        inside = (at >= 0) & (at < len(region))
        differ = np.ones(width, np.int64)
        differ[inside] = region[at[inside]] != c
        new = np.where(inside, row + differ * scale, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + scale)  # item byte without partner
        new = np.minimum.accumulate(new - step) + step  # region bytes without partner
        new[(diag + i + 1 < 0) | (diag + i + 1 > len(region))] = far
        row = new
        if row.min() >= (budget + 1) * scale:
            return budget + 1, 0, 0
    best = int(np.argmin(row))
    return int(row[best] // scale), int(row[best] % scale), int(diag[best] + len(item))


def find_items(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, first byte, last byte + 1, distance, shared) of the best region per text and item."""
    q = index.q
    if len(data) < q or not len(index.gram):
        return []
    gram = grams_of(data, q)
    at = np.flatnonzero(index.filter[(gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = at + q <= offsets[owner + 1]
    at, owner = at[inside], owner[inside]
    wanted = gram[at]
    low, high = np.searchsorted(index.gram, wanted), np.searchsorted(index.gram, wanted, "right")
    n = high - low
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item = index.item[entry].astype(np.int64)
    owner = np.repeat(owner, n)
    diagonal = np.repeat(at, n) - offsets[owner] - index.place[entry]
    band = diagonal // index.width[item]
    shift = int(index.size.max()) + 2
    # pairs are numbered anew, so that number and band fit a key: a step has fewer hits than 2**31
    pairs, number = np.unique(owner * len(index.ids) + item, return_inverse=True)
    if len(pairs) >= 1 << 31:
        raise OverflowError("too many candidate pairs in one step")
    keys = (number << 32) + band + shift
    keys = np.concatenate([keys, keys - 1])  # every diagonal is in two bands
    keys, shared = np.unique(keys, return_counts=True)
    pair, band = pairs[keys >> 32], (keys & 0xFFFFFFFF) - shift
    item = pair % len(index.ids)
    retained = shared >= index.need[item]
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for p, b, s in zip(pair[retained].tolist(), band[retained].tolist(), shared[retained].tolist(), strict=True):
        text, i = divmod(p, len(index.ids))
        width, budget, size = int(index.width[i]), int(index.budget[i]), int(index.size[i])
        first, last = b * width, (b + 2) * width - 1
        bytes_ = data[offsets[text] : offsets[text + 1]]
        # a path may leave the band of its shared q-grams by its edits before and after them
        left = max(0, first - budget)
        region = bytes_[left : last + budget + size]
        whole = region.tobytes().find(index.texts[i].tobytes())
        if whole >= 0:
            found = (0, whole, whole + size)
        else:
            found = align(index.texts[i], region, first - budget - left, last + budget - left, budget)
        if found[0] <= budget:
            hit = (found[0], left + found[1], left + found[2], s)
            if (text, i) not in best or hit < best[text, i]:
                best[text, i] = hit
    return [(t, i, start, end, cost, s) for (t, i), (cost, start, end, s) in sorted(best.items())]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Index] = shared.value
        for whole in batches:
            for batch in steps(whole):
                data, offsets = text_buffers(batch.column(1))
                data = _FOLD[data]
                rows = []
                for index, (text, item, start, end, cost, count) in ((i, hit) for i in parts for hit in find_items(i, data, offsets)):
                    own = data[offsets[text] : offsets[text + 1]]
                    places = [int(np.count_nonzero((own[:k] & 0xC0) != 0x80)) for k in (start, end)]
                    doc = batch.column(0)[text].as_py()
                    rows += [(doc, item_id, *places, cost, int(index.budget[item]), count) for item_id in index.ids[item]]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 2 + [pa.int32()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "distance", "budget", "shared"])

    return run


def _blocks(benchmark: DataFrame, block_bytes: int, least: int) -> Iterator[list[tuple[list[int], bytes]]]:
    """Folded items in blocks of bounded size, streamed from the table."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where(F.octet_length("t") >= least)
    block: dict[bytes, list[int]] = {}
    size = 0
    for row in items.orderBy("i", "t").toLocalIterator():
        text = _FOLD[np.frombuffer(row["t"].encode(), np.uint8)].tobytes()
        if text not in block and size + len(text) > block_bytes and block:
            yield [(ids, t) for t, ids in block.items()]
            block, size = {}, 0
        if text not in block:
            size += len(text)
        ids = block.setdefault(text, [])
        if row["i"] not in ids:
            ids.append(row["i"])
    if block:
        yield [(ids, t) for t, ids in block.items()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, edit_share: float = EDIT_SHARE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per contaminated document and item: the region, its distance and the edit budget."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, block_bytes, least):
        hits = rows.mapInArrow(thrifty(_search(spark.sparkContext.broadcast(indexes(block, q, edit_share)))), HIT)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], HIT)
