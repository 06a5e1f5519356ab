"""Vectorised text primitives over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole batch at once: white space is
``[\\x20\\x09-\\x0D]``, lower-casing touches A-Z only, a null text is an empty one.
Words and shingles are identified by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALTS = _RNG.integers(1, 2**63, 64, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def free_unused() -> None:
    """Drop the tables of powers, and give memory of finished work back to the system, where the platform allows."""
    _powers[:] = [table[:1].copy() for table in _powers]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(run):
    """``run`` with its memory given back at the end of each task, as workers live on beside the next ones.

    ``whole`` is pickled by value with the globals that it names, so it names functions of this module only.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        free_unused()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends."""
    column = text_array(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` holding about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and begin, end and text number of every word."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_IS_SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts = inside & ~before
    ends = before & ~inside
    cut = edges[inside[edges] & before[edges]]
    starts[cut] = True
    ends[cut] = True
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return data, begin, end, np.searchsorted(offsets, begin, "right") - 1


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """A fixed random number for every byte."""
    return _BYTE[data]


def symbol_sums(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the difference of two gives a substring's hash."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][:-1], out=sums[1:], dtype=np.uint64)
    return sums


def range_sums(data: np.ndarray) -> np.ndarray:
    return symbol_sums(_BYTE[data])


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [begin, end)."""
    raw = (sums[end] - sums[begin]) * powers(len(sums))[1][begin]
    return mix(raw + (end - begin).astype(np.uint64) * _SALTS[salt])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    data, begin, end, owner = words(data, offsets)
    return span_hash(range_sums(data), begin, end), owner


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every ``size``-word shingle, repeats included.

    A text of fewer words has one shingle, its whole word sequence; a text
    without words has none.
    """
    hashes, owner = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += mix(hashes[at + k] + _SALTS[k + 1])
    whose = owner[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        extra[has] += mix(hashes[first[short[has]] + k] + _SALTS[k + 1 + size])
    out = mix(np.concatenate([total, extra + counts[short].astype(np.uint64)]))
    return out, np.concatenate([whose, short])


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text's begin (n + 1)."""
    if len(owner) and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    at = np.searchsorted(owner, np.arange(n + 1))
    hashes = hashes.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(n + 1))
