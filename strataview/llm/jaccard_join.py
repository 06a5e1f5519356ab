"""Exact n-gram Jaccard join through a token-group matrix.

Documents with the same shingle set are one *node*.

1. *Groups.*  Every node has ``BANDS`` keys made of minima of its set (one permutation, cut into
   bins).  Nodes that share a key are loosely similar; their components are the groups
   ("families"), and a node alone is a group of one.  Whatever this misses costs
   work in step 3, never a link.
2. *Inside groups.*  A group is opened by its own members, in tiles of at most ``TILE`` nodes
   and ``TILE_TOKENS`` tokens, so that no task holds an unbounded group.
3. *Between groups*, the token-group matrix, laid out by token.  Every node contributes its rarest
   ``|x| - ceil(t|x|) + l`` tokens, with ``l = 1 + |x| / 40``; of two linked nodes these parts share
   ``l`` tokens at least (the smaller node's l), and of the smaller node its rarest
   ``|x| - ceil(2t / (1 + t) |x|) + l`` are enough.  A group's row of the matrix is the union of its
   members' such parts.  A node asks each group of another family that holds nodes of fitting,
   no larger size, and the group qualifies if the union holds ``l`` of the node's tokens (of a group of one,
   also if the tokens behind the last shared one could make up the rest).
4. *Opening.*  Nodes are compared with a group's members only if the group's whole token union
   holds ``t|x|`` of their tokens; intersections are products of 0/1 matrices, so exact.

"Rarest" follows a fixed-size count sketch over all documents.  It only orders the tokens, so
its collisions cost speed, never links; common lines and passages come last and are
hardly ever among a node's contributed tokens.

Defined cases: texts without words (null, empty, white space) have no shingles and link
with nothing; fewer words than the shingle size make one shingle; rows that repeat are the same
node; a null id stays in the result and takes the smallest id of its component, or
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.components import connected_components, forest
from strataview.llm.staging import BROADCAST_ROWS, join_groups, keep_rows, release, stage
from strataview.llm.textkit import distinct_sets, mix, shingle_hashes, steps, text_buffers, thrifty

WORDS = 5
#: Threshold as hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH_BITS, SLICES = 20, 64
#: Bins of the permutation (leading bits of a token), and bins that make one key.
BIN_BITS, ROWS_A_BAND = 6, 3
BANDS = (1 << BIN_BITS) // ROWS_A_BAND
#: (key, node) pairs that a task combines before it sends them on.
COMBINED = 2_000_000
#: Nodes and tokens of a tile.
TILE, TILE_TOKENS = 2048, 1_500_000
#: One more token is contributed, and must be shared, for every so many of a node.
SPARE = 40
#: Queries sent to one copy of a group's tile.
QUERIES_A_COPY = 1000
#: Columns of a dense product, and the documents a token may have to be counted pair by pair in a large unit.
WIDTH, LIGHT = 2048, 8
#: Rows of the intersections that are compared with the threshold at once.
ROWS_A_TEST = 256
_SEED1, _SEED2 = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def document_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(batch.column(1))
    return distinct_sets(*shingle_hashes(data, offsets, words), len(offsets) - 1)


def set_ids(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit identities of each set."""
    size = np.diff(at).astype(np.uint64)
    out = []
    for seed in (_SEED1, _SEED2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ seed), dtype=np.uint64)])
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + size * seed).view(np.int64))
    return out[0], out[1]


def band_keys(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each set: an empty bin takes the minimum of the next bin that has one."""
    n, bins = len(at) - 1, 1 << BIN_BITS
    if not n:
        return np.zeros((0, BANDS), np.int64)
    place = np.repeat(np.arange(n), np.diff(at)) * bins + (tokens >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    least = np.zeros(n * bins, np.uint64)
    least[place[first]] = tokens[first]
    full = np.zeros(n * bins, bool)
    full[place[first]] = True
    least, full = np.tile(least.reshape(n, bins), 2), np.tile(full.reshape(n, bins), 2)
    source = np.where(full, np.arange(2 * bins), 2 * bins - 1)
    source = np.minimum.accumulate(source[:, ::-1], axis=1)[:, ::-1][:, : BANDS * ROWS_A_BAND]
    value = mix(np.take_along_axis(least, source, 1) + (source - np.arange(BANDS * ROWS_A_BAND)).astype(np.uint64))
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
    for k in range(ROWS_A_BAND):
        keys = mix(keys + value[:, k::ROWS_A_BAND])
    return keys.view(np.int64)


DESCRIBED = "doc_id long, n_shingles long, node long, check long, bands array<long>, slice int, counts binary"


def _describe(words: int):
    """Rows of the documents, and the slices of this task's count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n_shingles", "node", "check", "bands", "slice", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for whole in batches:
            for batch in steps(whole):
                tokens, at = document_sets(batch, words)
                places, times = np.unique((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
                sketch[places] += times.astype(np.int32)
                n = np.diff(at)
                node, check = set_ids(tokens, at)
                empty = n == 0
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(band_keys(tokens, at).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(node, mask=empty), pa.array(check, mask=empty), bands, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names
                )
        if sketch.any():
            parts = [zlib.compress(p.astype("<i8").tobytes(), 1) for p in np.split(sketch, SLICES)]
            nulls = [pa.nulls(SLICES, k) for k in kinds[:5]]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketch slices of a partition, one at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slice_, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(counts), "<i8")
            sums[slice_] = sums[slice_] + part if slice_ in sums else part
    if sums:
        packed = [zlib.compress(v.tobytes(), 1) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])


def count_sketch(described: DataFrame) -> np.ndarray:
    """Counts by the tokens' leading bits: 2**SKETCH_BITS numbers at any corpus size."""
    parts = described.where("slice is not null").select("slice", "counts")
    spread = parts.repartition(2 * SLICES, "slice", F.pmod(F.crc32("counts"), F.lit(4))).mapInArrow(thrifty(_add_slices), "slice int, counts binary")
    rows = spread.repartition(SLICES, "slice").mapInArrow(thrifty(_add_slices), "slice int, counts binary").collect()  # SLICES rows
    sketch = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for row in rows:
        sketch[row["slice"]] += np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return np.minimum(sketch.ravel(), (1 << 31) - 1).astype(np.int32)


def _combine_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, head, null) for the least node of each key in this task, (any, node, head) for its others."""

    def combined(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        head = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        other = node != head
        pairs = np.unique(np.column_stack([node[other], head[other]]), axis=0)
        columns = [np.concatenate([key[first], mix(pairs[:, 0].view(np.uint64)).view(np.int64)]), np.concatenate([node[first], pairs[:, 0]])]
        heads = pa.array(np.concatenate([np.zeros(int(first.sum()), np.int64), pairs[:, 1]]), mask=np.arange(len(columns[0])) < first.sum())
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), heads], ["key", "node", "head"])

    keys: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            keys.append(batch.column(1).flatten().to_numpy())
            nodes.append(np.repeat(batch.column(0).to_numpy(), BANDS))
        if sum(map(len, keys)) > COMBINED:
            yield combined(keys, nodes)
            keys, nodes = [], []
    if keys:
        yield combined(keys, nodes)


def _key_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from every node of a key to the key's least; rows are sorted by key and node."""
    last, its_head = None, None
    for batch in batches:
        done = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        if done.any():
            ready = batch.filter(pa.array(done))
            yield pa.RecordBatch.from_arrays([ready.column(1), ready.column(2)], ["a", "b"])
        key, node = (batch.column(k).to_numpy()[~done] for k in (0, 1))
        if not len(key):
            continue
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        head = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        if last is not None and key[0] == last:
            head[: int(np.searchsorted(key, last, "right"))] = its_head
        last, its_head = key[-1], head[-1]
        other = node != head
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(head[other])], ["a", "b"])


def find_groups(described: DataFrame) -> DataFrame:
    """(node, component) of all nodes that share a key with another."""
    keys = described.where("node is not null").select("node", "bands").mapInArrow(thrifty(_combine_keys), "key long, node long, head long")
    edges = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(thrifty(_key_edges), "a long, b long")
    return connected_components(edges)


def _matrix_rows(words: int, percent: int, sketch):
    """(token, node) of each node's rarest tokens; repeats within a step are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sketch.value
        for whole in batches:
            for batch in steps(whole):
                tokens, at = document_sets(batch, words)
                n = np.diff(at)
                node, _ = set_ids(tokens, at)
                _, first = np.unique(node, return_index=True)
                wanted = np.zeros(len(n), bool)
                wanted[first] = True
                wanted &= n > 0
                share = np.minimum(n, n - (percent * n + 99) // 100 + 1 + n // SPARE)
                owner = np.repeat(np.arange(len(n)), n)
                key = (owner.astype(np.int64) << 32) | rarity[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(key, kind="stable")  # ties keep the order of the hashes
                rank = np.arange(len(order)) - np.repeat(at[:-1], n)
                take = (rank < share[owner]) & wanted[owner]
                picked = order[take]
                columns = [tokens[picked].view(np.int64), node[owner[take]], rank[take].astype(np.int32), n[owner[take]].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "rank", "size"])

    return run


MATRIX = "token long, node long, rank int, size int"


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node: distinct rows whose token has two nodes or more.

    The last row of a batch waits for the next one; of a run that goes on only that row is held.
    """
    held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)] * 2
    known = False  # the waiting row's token has had another node
    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [r[new] for r in rows]
        token = rows[0]
        if not len(token):
            continue
        keep = np.zeros(len(token), bool)
        keep[1:] = token[1:] == token[:-1]
        keep[0] = known
        known = bool(keep[-1])
        keep[:-1] |= token[:-1] == token[1:]
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], ["token", "node", "rank", "size"])
        held = [r[-1:] for r in rows]
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["token", "node", "rank", "size"])


PLACED = MATRIX + ", grp long, large boolean"
#: Rows of one token that wait for a second group to show up; beyond, they are passed on.
WAITING = 200_000


def _several_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token: those whose token has two groups or more."""
    waiting: list[pa.RecordBatch] = []
    passed = None  # the last token of which rows were passed on

    def chosen(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        token, grp = table.column("token").to_numpy(), table.column("grp").to_numpy()
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        several = np.maximum.reduceat(grp, first) != np.minimum.reduceat(grp, first)
        several |= token[first] == passed if passed is not None else False
        return table.filter(pa.array(np.repeat(several, np.diff(np.append(first, len(token)))))).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        change = np.flatnonzero(token[1:] != token[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0  # the last token may go on
        if cut or (waiting and waiting[-1].column(0)[-1].as_py() != token[-1]):
            yield from chosen([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
        if sum(b.num_rows for b in waiting) > WAITING:
            yield from waiting
            waiting, passed = [], token[-1]
    if waiting:
        yield from chosen(waiting)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                tokens, at = document_sets(batch, words)
                node, _ = set_ids(tokens, at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "tokens"])

    return run


def intersections(tokens: np.ndarray, whose: np.ndarray, asks: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Shared tokens of every asking set (rows) and opened set (columns).

    ``tokens`` are numbered from 0 in the order of the rows given; products of 0/1 matrices,
    ``WIDTH`` tokens at a time.
    """
    row, column = np.full(int(whose.max()) + 1, -1), np.full(int(whose.max()) + 1, -1)
    row[asks], column[opened] = np.arange(len(asks)), np.arange(len(opened))
    out = np.zeros((len(asks), len(opened)), np.float32)
    if len(asks) * len(opened) > 1 << 16:  # rare tokens, pair by pair
        times = np.bincount(tokens)
        for d in range(1, LIGHT + 1):
            member = whose[(times == d)[tokens]].reshape(-1, d)
            for i in range(d):
                for j in range(d):
                    r, c = row[member[:, i]], column[member[:, j]]
                    good = (r >= 0) & (c >= 0)
                    if good.any():
                        np.add.at(out, (r[good], c[good]), 1)
        heavy = (times > LIGHT)[tokens]
        tokens, whose = np.unique(tokens[heavy], return_inverse=True)[1], whose[heavy]
    total = int(tokens[-1]) + 1 if len(tokens) else 0
    cuts = np.searchsorted(tokens, np.arange(0, total + WIDTH, WIDTH))
    for k, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        t, w = tokens[low:high] - k * WIDTH, whose[low:high]
        left, right = np.zeros((len(asks), WIDTH), np.float32), np.zeros((len(opened), WIDTH), np.float32)
        a, b = row[w] >= 0, column[w] >= 0
        left[row[w[a]], t[a]] = 1
        right[column[w[b]], t[b]] = 1
        out += left @ right.T
    return out


def open_unit(role: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of set numbers that lead to each linked set of a unit: role 1 asks, 2 is opened, 3 both.

    Linked sets are given as a forest: each with the least of its component.
    """
    sizes = sizes.astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    token, whose = tokens[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    del order
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    again[:-1] |= again[1:].copy()
    token, whose = token[again], whose[again]  # others are in no intersection
    # the union of the other sets holds enough of a set's tokens, or it links with none
    held = np.bincount(whose, minlength=len(sizes))
    able = 100 * held >= percent * sizes
    asks, opened = np.flatnonzero(able & (role & 1 > 0)), np.flatnonzero(able & (role & 2 > 0))
    if not len(asks) or not len(opened):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = able[whose]
    token, whose = token[live], whose[live]
    number = np.zeros(len(token), np.int64)
    number[1:] = np.cumsum(token[1:] != token[:-1])
    shared = intersections(number, whose, asks, opened)
    # in integers, a few rows at a time: products of large sets are not exact in 32-bit floats
    found = []
    for low in range(0, len(asks), ROWS_A_TEST):
        both = sizes[asks[low : low + ROWS_A_TEST], None] + sizes[None, opened]
        found.append(np.argwhere((100 + percent) * shared[low : low + ROWS_A_TEST].astype(np.int64) >= percent * both) + [low, 0])
    a, b = np.concatenate(found).T
    a, b = asks[a], opened[b]
    return forest(len(sizes), a[a != b], b[a != b])


def _open(percent: int):
    """Links of all units; rows (unit, role, node, tokens) are sorted by unit."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        node, role = table.column("node").to_numpy(), table.column("role").to_numpy()
        lists = table.column("tokens").combine_chunks()
        at = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        unit = table.column("unit").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, first, back = np.unique(node[low:high], return_index=True, return_inverse=True)  # repeated rows give a set again
            if len(own) < 2:
                continue
            roles = np.zeros(len(own), np.int64)
            np.bitwise_or.at(roles, back, role[low:high].astype(np.int64))
            first = first + low
            sizes = at[first + 1] - at[first]
            tokens = np.concatenate([values[at[k] : at[k + 1]] for k in first])
            a, b = open_unit(roles, sizes, tokens, percent)
            out[0].append(own[a])
            out[1].append(own[b])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            change = np.flatnonzero(unit[1:] != unit[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0  # the last unit may go on
            if waiting and (cut or waiting[-1].column(0)[-1].as_py() != unit[-1]):
                waiting.append(batch.slice(0, cut))
                yield links(waiting)
                waiting = []
            elif cut:
                yield links([batch.slice(0, cut)])
            waiting.append(batch.slice(cut))
        if waiting:
            yield links(waiting)

    return run


def open_units(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``units`` (unit, role, node); few of them go to the sets by broadcast."""
    wanted = F.broadcast(units) if units.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else units
    rows = sets.join(wanted, "node").select("unit", "role", "node", "tokens")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(thrifty(_open(percent)), "a long, b long")


def between_groups(placed: DataFrame, percent: int) -> DataFrame:
    """(query, grp): groups whose row of the matrix holds enough of a node of another group.

    ``placed``: token, node, rank, size, grp, large (the group has several nodes).
    """

    def spare(size: str):
        return F.floor(F.col(size) / SPARE) + 1

    # of the smaller one of two linked nodes the shared tokens come this early
    early = F.col("rank") < F.col("size") - F.floor((2 * percent * F.col("size") + 99 + percent) / (100 + percent)) + spare("size")
    matrix = placed.where(early).groupBy("token", "grp").agg(F.min("size").alias("m"), F.max("size").alias("most"), F.max("rank").alias("at"), F.max("large").alias("large"))
    asking = placed.select("token", F.col("node").alias("query"), F.col("size").alias("n"), "rank", F.col("grp").alias("own"), F.col("large").alias("in_large"))
    fits = (F.col("m") <= F.col("n")) & (100 * F.col("most") >= percent * F.col("n"))
    # of two nodes of one size a single one asks: the lone one the other's group, else the greater
    once = F.col("large") | (F.col("m") < F.col("n")) | (~F.col("in_large") & (F.col("grp") < F.col("query")))
    shared = asking.join(matrix, "token").where((F.col("own") != F.col("grp")) & fits & once)
    shared = shared.groupBy("query", "grp", "large").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("m").alias("m"), F.max("rank").alias("i"), F.max("at").alias("j"))
    reach = F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    # a union's last shared rank may come from another member than the one that links
    reaches = F.col("large") | (reach * (100 + percent) >= percent * (F.col("n") + F.col("m")))
    return shared.where((F.col("c") >= F.least(spare("n"), spare("m"))) & reaches).select("query", "grp")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = stage(texts.mapInArrow(thrifty(_describe(words)), DESCRIBED), "described")
    sketch = spark.sparkContext.broadcast(count_sketch(described))
    rows = described.where("slice is null").select("doc_id", "n_shingles", "node", "check")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.max("n_shingles").alias("size")
    )
    nodes = stage(nodes, "nodes")
    if nodes.where("c1 <> c2").limit(1).count():
        raise ValueError("two different shingle sets share an identity")

    # groups of similar nodes, each cut into tiles
    groups = find_groups(described).withColumnRenamed("component", "grp")
    sized = groups.join(nodes.select("node", "size"), "node")
    tiles = sized.groupBy("grp").agg((F.greatest(F.floor(F.count("*") / TILE), F.floor(F.sum("size") / TILE_TOKENS)) + 1).cast("int").alias("tiles"))
    members = groups.join(tiles, "grp").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = stage(members.select("grp", "tiles", "tile", "node"), "members")
    other = members.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.xxhash64(F.lit(0), "grp", F.least("tile", "u"), F.greatest("tile", "u")).alias("unit")
    inside = other.select(pair, F.when(F.col("tile") == F.col("u"), 3).when(F.col("tile") < F.col("u"), 1).otherwise(2).alias("role"), "node")

    # the matrix, and what qualifies between groups
    matrix = texts.mapInArrow(thrifty(_matrix_rows(words, percent, sketch)), MATRIX)
    matrix = matrix.repartition("token").sortWithinPartitions("token", "node").mapInArrow(thrifty(_shared_only), MATRIX)
    whose, few = members.select("node", "grp"), members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = matrix.join(F.broadcast(whose) if few else whose, "node", "left").withColumn("large", F.col("grp").isNotNull()).withColumn("grp", F.coalesce("grp", "node"))
    placed = placed.select("token", "node", "rank", "size", "grp", "large")
    placed = (placed if few else placed.repartition("token")).sortWithinPartitions("token").mapInArrow(thrifty(_several_groups), PLACED)
    placed = stage(placed, "matrix")
    asked = stage(between_groups(placed, percent), "asked")
    release(placed)
    blocks = members.select("grp", "tile", F.col("node").alias("member"))
    lone = asked.join(members.select("grp").distinct(), "grp", "left_anti").select("grp").distinct().select("grp", F.lit(0).alias("tile"), F.col("grp").alias("member"))
    blocks = blocks.join(asked.select("grp").distinct(), "grp", "left_semi").unionByName(lone)
    copies = asked.groupBy("grp").agg((F.floor(F.count("*") / QUERIES_A_COPY) + 1).cast("int").alias("copies"))
    unit = F.xxhash64(F.lit(1), "grp", "tile", "copy").alias("unit")
    queries = asked.join(copies, "grp").withColumn("copy", F.pmod(F.xxhash64("query"), F.col("copies")).cast("int"))
    queries = queries.join(blocks.select("grp", "tile").distinct(), "grp").select(unit, F.lit(1).alias("role"), F.col("query").alias("node"))
    opened = blocks.join(copies, "grp").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    opened = opened.select(unit, F.lit(2).alias("role"), F.col("member").alias("node"))
    units = stage(inside.unionByName(queries).unionByName(opened), "units")

    # whole sets of the nodes concerned, and the links
    ids = nodes.join(units.select("node").distinct(), "node", "left_semi").select("least_id")
    sets = keep_rows(texts, ids, "least_id", F.col("doc_id")).mapInArrow(thrifty(_sets(words)), "node long, tokens array<long>")
    links = stage(open_units(units, sets, percent), "links")
    release(units)
    final = connected_components(links)
    release(links)

    named = final.join(nodes.select("node", "least_id"), "node").withColumnRenamed("component", "c")
    best = named.groupBy("c").agg(F.min("least_id").alias("component_id"))
    linked = named.join(best, "c").select("node", "component_id")
    labels = nodes.join(linked, "node", "left").select("node", "n", F.coalesce("component_id", "least_id").alias("component_id"))
    labels = stage(labels.where("n > 1").unionByName(labels.join(linked.select("node"), "node", "left_semi").where("n = 1")), "labels")
    out = join_groups(rows, labels, "node", "n", rows.count())
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
