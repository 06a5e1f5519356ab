"""Merging of shard Burrows-Wheeler transforms by interleave refinement (in memory).

A shard's transform is built from its own texts.  Two transforms are merged without
sorting suffixes: an interleave (which shard the next suffix comes from) starts as "all of
the first, then all of the second" and is refined by stable bucketing on the transform's
symbols; after h passes suffixes are ordered by their first h symbols.  A boundary between
neighbours that appears in pass h is a common prefix of h - 1 symbols, so after ``depth``
passes the neighbours without boundary share ``depth`` symbols at least: the repeated intervals.

It gives the same spans as ``repeats.remove_repeats``, at a cost of ``depth`` passes over all
suffixes; see the README for the measured figures.
"""

from __future__ import annotations

import numpy as np


def transform(texts: list[bytes]) -> np.ndarray:
    """Transform of a few texts, each closed by an end (symbol 0); ends are ordered by text."""
    codes = [np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), k) for k, t in enumerate(texts)]
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    rank, span = flat.copy(), 1
    while len(flat):
        after = np.full(len(flat), -1, np.int64)
        after[: len(flat) - span] = rank[span:]
        order = np.lexsort((after, rank))
        new = np.ones(len(flat), np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(len(flat), np.int64)
        rank[order] = np.cumsum(new) - 1
        if rank.max() == len(flat) - 1:
            break
        span *= 2
    order = np.argsort(rank)
    before = flat[order - 1]
    return np.where(before < len(texts), 0, before - len(texts) + 1).astype(np.uint16)


def _texts_in(bwt: np.ndarray) -> int:
    return int(np.count_nonzero(bwt == 0))


def merge(first: np.ndarray, second: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merged transform, and per neighbour pair the pass in which they parted (0: not within ``depth``).

    Without ``depth`` passes go on until the interleave is stable and all have parted.
    """
    n = len(first) + len(second)
    ends = _texts_in(first) + _texts_in(second)
    source = np.zeros(n, bool)
    source[len(first) :] = True
    parted = np.zeros(n, np.int32)  # boundary before each place
    group = np.zeros(n, np.int64)
    passes = 0
    while depth is None or passes < depth:
        passes += 1
        symbols = np.empty(n, np.uint16)
        symbols[~source], symbols[source] = first, second
        # ends come in order of texts: those of the first shard before those of the second
        order = np.argsort(symbols, kind="stable")
        order[:ends] = order[:ends][np.argsort(source[order[:ends]], kind="stable")]
        refined = source[order]
        sym, grp = symbols[order], group[order]
        new = np.ones(n, bool)
        new[1:] = (sym[1:] != sym[:-1]) | (grp[1:] != grp[:-1])
        new[:ends] = True
        fresh = new & (parted == 0)
        parted[fresh] = passes
        if depth is None and (refined == source).all() and not fresh.any():
            break
        source, group = refined, np.cumsum(new)
    merged = np.empty(n, np.uint16)
    merged[~source], merged[source] = first, second
    return merged, parted


def suffix_places(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and distance from its end of the suffix at each place, by walking all texts backwards at once."""
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt))
    texts = _texts_in(bwt)
    at, whose = np.arange(texts), np.arange(texts)
    owner, back = np.zeros(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    passed = 0
    while len(at):
        owner[at], back[at] = whose, passed
        going = bwt[at] != 0
        at, whose = step[at[going]], whose[going]
        passed += 1
    return owner, back


def repeated_spans(texts: list[bytes], length: int, shards: int = 2) -> list[list[tuple[int, int]]]:
    """Per text the byte ranges covered by strings of ``length`` bytes that also start elsewhere."""
    parts = [transform(texts[k * len(texts) // shards : (k + 1) * len(texts) // shards]) for k in range(shards)]
    bwt = parts[0]
    for k, part in enumerate(parts[1:], 2):
        bwt, parted = merge(bwt, part, length + 1 if k == len(parts) else None)
    if len(parts) == 1:
        bwt, parted = merge(bwt, np.zeros(0, np.uint16), length + 1)
    owner, back = suffix_places(bwt)
    shared = (parted == 0) | (parted > length)  # with the place before: length symbols in common
    repeated = shared.copy()
    repeated[:-1] |= shared[1:]
    repeated &= back >= length
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    for k, b in sorted(zip(owner[repeated].tolist(), (sizes[owner[repeated]] - back[repeated]).tolist(), strict=True)):
        if out[k] and b <= out[k][-1][1]:
            out[k][-1] = (out[k][-1][0], b + length)
        else:
            out[k].append((b, b + length))
    return out
