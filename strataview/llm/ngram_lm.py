"""N-gram language model as a weighted backoff automaton, built block by block.

States are the n-gram contexts of the training texts: the root (no context), words, and longer contexts of up to
``order - 1`` words.  A state's arcs are the n-grams of the training texts; where a word has no arc, the
failure arc leads to the state of the shortened context and costs its weight.  One left-to-right
traversal of a text carries the state and adds up log10 probabilities; the texts of a block take each step together.

Every n-gram of the corpus counts, however rare, so the counts grow with the input and are neither
cut nor broadcast.  A block is a run of rows of one file with some BLOCK_BYTES of text (by the mean size of rows; a run that
holds more than twice as much, as where a table is ordered by length, is cut by its running bytes):

1. each block lists its distinct n-grams by order, with their counts in its own training texts,
   as sorted 64-bit keys in chunks by key range;
2. each key range adds up what all blocks sent, and answers every block with the totals of the keys it
   asked for, in their order;
3. each block meets its answers, makes the automaton of those of its n-grams that occur in training, with the
   corpus-wide counts (states and arcs that no text of the block can reach are not sent), and traverses it.

A common n-gram is sent once a block, so no key crowds a range with more than its number of blocks.

Smoothing: an arc has (c(h, w) + m * P(w | h')) / (c(h) + m), h' being h without its first word; the failure
arc of h costs m / (c(h) + m).  For every state the probabilities add up to one.  At the root, the discounts of all
distinct words make the probability of one unknown word.  ``STRENGTHS`` are m by order from 2; the README
tells how they were picked.

Counts cover all training documents (those whose crc32(doc_id) mod 10 is not 0).

Defined cases: a null text is an empty one and has the end token alone; rows that repeat
are scored each (and each counts in training); with an empty training table every word is unknown
and has the log10 probability of 1 / (V + 1) = 1, that is 0; an empty table gives an
empty result; a text longer than BLOCK_BYTES is a block of its own size, and no other block has more than twice BLOCK_BYTES and one row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataview.llm.staging import BROADCAST_ROWS, crc_bucket, stage
from strataview.llm.textkit import free_unused, mix, steps, text_buffers, thrifty, word_hashes

ORDER = 3
STRENGTHS = (300.0, 2.0)
DISCOUNT = 0.7
FOLDS = 10
#: Text bytes of a block, keys of a range.
BLOCK_BYTES = 8 << 20
RANGE_KEYS = 4_000_000
#: Bytes of a batch of chunks, n-grams that one vectorised step handles, and parts in which the n-grams of a block are sorted.
SENT_BYTES = 1 << 20
PIECE = 1 << 17
#: Tokens of a long text that are traversed in one go.
SEGMENT = 1024
BANDS = 8
#: Identity of the end token: no word's hash is kept equal to it (one in 2**64).
END = np.uint64(2**64 - 1)
_PLACE = 0x9E3779B97F4A7C15


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and text numbers of a batch, every text closed by the end token."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
    hashes, owner = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(hashes) + n, END)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = np.where(hashes == END, np.uint64(0), hashes)
    return out, np.repeat(np.arange(n), counts + 1)


def grams(tokens: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of order ``k`` within a text, and the places of their last tokens."""
    if k == 1:
        return tokens, np.arange(len(tokens), dtype=np.int32)
    at = (np.flatnonzero(owner[k - 1 :] == owner[: max(len(owner) - k + 1, 0)]) + k - 1).astype(np.int32)
    keys = np.empty(len(at), np.uint64)
    for a in range(0, len(at), PIECE):
        piece = at[a : a + PIECE]
        total = np.full(len(piece), k, np.uint64)
        for j in range(k):
            total += mix(tokens[piece - j] + np.uint64(_PLACE * (j + 1) % 2**64))
        keys[a : a + PIECE] = mix(total)
    return keys, at


def encode(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed here already, as executors hold and sort what is sent."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="lz4_raw", asbytes=True)


def decode(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = pa.decompress(memoryview(data)[8:], 8 * n, codec="lz4_raw")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def encode_sorted(keys: np.ndarray) -> bytes:
    steps_ = keys.copy()
    steps_[1:] -= keys[:-1]
    return encode(steps_)


def decode_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(decode(data), dtype=np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the order of all (stable), and where in it each key begins."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], order, np.flatnonzero(new)


def _sum_by(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, order, begin = _runs(np.concatenate(keys))
    return found, np.add.reduceat(np.concatenate(counts)[order], begin) if len(begin) else np.zeros(0, np.int64)


def _requests(order: int, ranges: int):
    """Chunks (part, block, keys, own) of the blocks' distinct n-grams; a part is an order and a key range.

    A block that a file split cuts sends from both sides; so does one with very many n-grams.  Its orders are
    sent one after the other, and what was held for one goes before the next.
    """
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())])

    # first key of every range's share of the bands
    share = -(-ranges // BANDS)
    lows = [((p << 32) + ranges - 1) // ranges << 32 for p in range(0, ranges, share)]

    def packed(rows: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    def chunks(block: int, held: list[list]) -> Iterator[pa.RecordBatch]:
        for level, pairs in enumerate(held):
            cuts = [[*np.searchsorted(k, np.array(lows, np.uint64)).tolist(), len(k)] for k, _ in pairs]
            rows: tuple[list, ...] = ([], [], [], [])
            size = 0
            for band in range(len(lows) if pairs else 0):
                spans = [slice(c[band], c[band + 1]) for c in cuts]
                keys, own = _sum_by([k[x] for (k, _), x in zip(pairs, spans, strict=True)], [c[x] for (_, c), x in zip(pairs, spans, strict=True)])
                part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    if a == b:
                        continue
                    for column, value in zip(rows, (level * ranges + int(part[a]), block, encode_sorted(keys[a:b]), encode(own[a:b])), strict=True):
                        column.append(value)
                    size += len(rows[2][-1]) + len(rows[3][-1])
                    if size >= SENT_BYTES or len(rows[0]) == 1000:
                        yield packed(rows)
                        rows, size = ([], [], [], []), 0
            pairs.clear()
            if rows[0]:
                yield packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [[] for _ in range(order)], 0
        for whole in batches:
            blocks = whole.column(whole.schema.get_field_index("block")).to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                for batch in steps(whole.slice(a, b - a)):
                    if current is not None and (blocks[a] != current or size > 2 * RANGE_KEYS):
                        yield from chunks(current, held)
                        held, size = [[] for _ in range(order)], 0
                    current = int(blocks[a])
                    tokens, owner = tokens_of(batch)
                    train = batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False)[owner]
                    for level in range(order):
                        keys, at = grams(tokens, owner, level + 1)
                        held[level].append(_sum_by([keys], [train[at].astype(np.int64)]))
                        size += len(held[level][-1][0])
        if current is not None:
            yield from chunks(current, held)

    return run


def _totals(ranges: int):
    """Answers (block, part, totals) of a part; its first row also carries the part's training words."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        block = table.column("block").to_numpy()
        keys = [decode_sorted(v.as_py()) for v in table.column("keys")]
        own = [decode(v.as_py()) for v in table.column("own")]
        size = np.array([len(k) for k in keys])
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(back, np.concatenate(own), len(found)).astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(block, kind="stable")
        out_blocks, answers = [], []
        for chunk in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            places = back[begin[chunk[0]] : begin[chunk[0]] + size[chunk[0]]]
            if len(chunk) > 1:
                places = np.unique(np.concatenate([back[begin[c] : begin[c] + size[c]] for c in chunk.tolist()]))
            out_blocks.append(int(block[chunk[0]]))
            answers.append(encode(totals[places]))
        n = len(out_blocks)
        tokens, words = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if part < ranges:
            tokens[0], words[0] = totals.sum(), (totals > 0).sum()
        return pa.table({"block": pa.array(out_blocks, pa.int64()), "part": pa.array([part] * n, pa.int64()), "totals": pa.array(answers, pa.binary()), "tokens": tokens, "words": words})

    return run


class Automaton:
    """States and arcs of the trained n-grams that some texts hold.

    State 0 is the root; other states are the trained contexts, numbered by order and within it by key.  An arc is a trained n-gram: it leads from the
    state of its context with its last word to the state of the longest trained context that then ends there, and has a log10
    probability.  The root has an arc for every word, also for those never seen, which leads back to it.  Every
    other state has a failure arc to the state of its context without the first word, with the log10 of its weight.

    ``counts(level)`` gives the corpus-wide counts of the texts' n-grams of one order, for their sorted keys.
    """

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, order: int, counts, total: int, distinct: int, strengths: tuple[float, ...] = STRENGTHS):
        self.total, self.distinct, self.order, self.owner = total, distinct, order, owner
        arcs: dict[str, list[np.ndarray]] = {"keys": [np.zeros(0, np.int64)], "logs": [np.zeros(0)], "targets": [np.zeros(0, np.int32)]}
        fails, weights = [np.zeros(1, np.int32)], [np.zeros(1)]
        states = 1  # states numbered so far
        end = probability = before = state = None
        for level in range(order):
            below, (end, last) = end, self.sort(*grams(tokens, owner, level + 1), len(tokens))
            count = counts(level)
            if len(count) != len(last):
                raise ValueError(f"{len(count)} counts for {len(last)} n-grams of order {level + 1}")
            trained = count > 0
            numbers = np.where(trained, states - 1 + np.cumsum(trained, dtype=np.int32), 0).astype(np.int32) if level < order - 1 else np.zeros(len(last) if level == 0 else 0, np.int32)
            if level == 0:
                probability = self.root(count)
                #: of each token its word, of each word its count, log10 probability at the root and state
                self.word, self.words, self.root_logs, self.first_states = end, count, np.log10(probability), numbers
                shorter = np.zeros(len(last), np.int32)
            else:
                # arrays of a block's n-grams are large: each goes as soon as it can
                m, context, suffix = strengths[level - 1], below[last - 1], below[last]
                del below
                probability, shorter = probability[suffix], state[suffix]
                probability *= m
                probability += count
                probability /= before[context] + m
                found = slice(None) if trained.all() else np.flatnonzero(trained)
                key = state[context[found]].astype(np.int64)
                del context, suffix, before
                key *= len(self.words)
                key += self.word[last[found]]
                by_key = np.argsort(key).astype(np.int32)
                arcs["keys"].append(key[by_key])
                del key
                arcs["targets"].append((numbers if level < order - 1 else shorter)[found][by_key])
                arcs["logs"].append(np.log10(probability[found][by_key]))
                del by_key, found
            if level < order - 1:
                states += int(trained.sum())
                fails.append(shorter[trained])
                weights.append(np.log10(strengths[level] / (count[trained] + strengths[level])))
            before, state = count, numbers
            del count, last, trained, shorter
        del end, probability, before
        #: arcs by (state, word), the states of one order following those of the order before
        self.keys, self.logs, self.targets = (np.concatenate(arcs.pop(name)) for name in ("keys", "logs", "targets"))
        self.fails, self.weights = np.concatenate(fails), np.concatenate(weights)

    @staticmethod
    def sort(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of the n-gram that ends at each of ``n`` tokens, in order of the keys, and a place where each ends."""
        arc, places, found = np.full(n, -1, np.int32), [], 0
        top = keys.astype("<u8", copy=False).view(np.uint8)[7::8]
        for band in range(BANDS):
            where = np.flatnonzero(top // (256 // BANDS) == band)
            _, order, begin = _runs(keys[where])
            where = at[where[order]]
            arc[where] = np.repeat(np.arange(found, found + len(begin), dtype=np.int32), np.diff(begin, append=len(where)))
            places.append(where[begin])
            found += len(begin)
        return arc, np.concatenate(places).astype(np.int32)

    def root(self, count: np.ndarray) -> np.ndarray:
        """Probability of words with ``count`` training occurrences; 0: of the unknown word."""
        unknown = (DISCOUNT * self.distinct + 1) / (self.total + 1)
        return np.where(count > 0, np.maximum(count - DISCOUNT, 1e-9) / (self.total + 1), unknown)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities: failure arcs are followed until a state has an arc for the word."""
        state, out = state.copy(), np.zeros(len(state))
        going = np.flatnonzero(state) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            out += self.weights[state]  # an automaton of words alone: no state but fails
            state[:] = 0
        at_root = state == 0
        while len(going):
            key = state[going].astype(np.int64) * len(self.words) + word[going]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            taken, arc, failed = going[hit], arc[hit], going[~hit]
            out[taken] += self.logs[arc]
            state[taken] = self.targets[arc]
            out[failed] += self.weights[state[failed]]
            state[failed] = self.fails[state[failed]]
            done = state[failed] == 0
            at_root[failed[done]] = True
            going = failed[~done]
        out[at_root] += self.root_logs[word[at_root]]
        state[at_root] = self.first_states[word[at_root]]
        return state, out

    def traverse(self, visit=None) -> np.ndarray:
        """log10 probability of every token, from left to right with the state carried along.

        All texts take a step at a time together.  A long text goes in segments of ``SEGMENT`` tokens: a state depends on at most
        ``order - 1`` tokens, so a segment first takes those before it from the root.  ``visit(places, states)`` sees the states after each step.
        """
        n = len(self.word)
        starts = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=n)
        parts = -(-sizes // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        text_start, text_end = np.repeat(starts, parts), np.repeat(starts + sizes, parts)
        first = text_start + nth * SEGMENT
        begin, end = np.maximum(first - (self.order - 1), text_start), np.minimum(first + SEGMENT, text_end)
        longest = np.argsort(begin - end, kind="stable")
        first, begin, shorter = first[longest], begin[longest], (begin - end)[longest]
        state, out = np.zeros(len(first), np.int32), np.zeros(n)
        for t in range(-int(shorter[0]) if len(shorter) else 0):
            on = int(np.searchsorted(shorter, -t))  # segments of more than t tokens come first
            places = begin[:on] + t
            state[:on], logs = self.step(state[:on], self.word[places])
            own = places >= first[:on]
            out[places[own]] = logs[own]
            if visit is not None:
                visit(places[own], state[:on][own])
        return out


def _score(order: int, ranges: int, total: int, distinct: int, strengths: tuple[float, ...]):
    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        n, tokens, owner, before = texts.num_rows, [], [], 0
        for whole in texts.select(["text"]).to_batches():
            for batch in steps(whole):
                t, o = tokens_of(batch)
                tokens.append(t)
                owner.append((o + before).astype(np.int32))
                before += batch.num_rows
        if not tokens:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_sum": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        tokens, owner = np.concatenate(tokens), np.concatenate(owner)
        free_unused()  # the tables of powers
        part = answers.column("part").to_numpy()
        rows = [int(r) for r in np.argsort(part)]
        packed = answers.column("totals")

        def counts(level: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(decode(packed[r].as_py()).view("<i8") for r in rows if part[r] // ranges == level)])

        automaton = Automaton(tokens, owner, order, counts, total, distinct, strengths)
        del tokens
        word = automaton.word
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_tokens": np.bincount(owner, minlength=n).astype(np.int64),
                "n_known": np.bincount(owner, (automaton.words > 0)[word], n).astype(np.int64),
                "base_sum": np.bincount(owner, np.log10(automaton.words + 0.1)[word], n),
                "score": np.bincount(owner, automaton.traverse(), n),
            }
        )

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = scored(texts, answers)
        free_unused()
        return out

    return run


def _with_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc_id, text, file and row: where a row lies; rows that come from no file are staged first."""
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        return stage(docs.select(*columns), "texts").select("doc_id", "text", *place)


#: Rows whose sizes are added up together before blocks are laid out.
FINE = 256
#: A run of rows is cut if it holds more than so many times the bytes of a block.
SLACK = 2


def _in_blocks(placed: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text, block) and the bytes of all texts.

    A run of rows is as long as holds ``block_bytes`` at the mean size of rows.  Runs that hold too much are cut where their running bytes pass a
    multiple of ``block_bytes``; the window over a run sees places and sizes alone, never texts.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sums = stage(placed.groupBy("file", F.floor(F.col("row") / FINE).alias("fine")).agg(F.count("*").alias("n"), F.sum(size).alias("size")), "sizes")
    n, total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    fine = max(1, int(block_bytes * n // max(total, 1)) // FINE)
    placed = placed.withColumn("run", F.floor(F.col("row") / (fine * FINE)))
    runs = sums.groupBy("file", F.floor(F.col("fine") / fine).alias("run")).agg(F.sum("size").alias("size"))
    full = stage(runs.where(F.col("size") > SLACK * block_bytes).select("file", "run"), "full-runs")
    n_full = full.count()
    if n_full == 0:
        return placed.select("doc_id", "text", F.xxhash64("file", "run").alias("block")), int(total)
    within = placed.select("file", "run", "row", size.alias("size")).join(F.broadcast(full) if n_full <= BROADCAST_ROWS else full, ["file", "run"], "left_semi")
    before = Window.partitionBy("file", "run").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / block_bytes)
    firsts = within.withColumn("nth", nth).groupBy("file", "run", "nth").agg(F.min("row").alias("first"))
    cuts = stage(firsts.groupBy("file", "run").agg(F.sort_array(F.collect_list("first")).alias("firsts")), "cuts")  # at most a run's rows
    if cuts.agg(F.sum(F.size("firsts"))).first()[0] <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    piece = F.coalesce(F.size(F.filter("firsts", lambda x: x <= F.col("row"))), F.lit(0))
    rows = placed.join(cuts, ["file", "run"], "left")
    return rows.select("doc_id", "text", F.xxhash64("file", "run", piece).alias("block")), int(total)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (a token)."""
    placed = _with_place(docs, id_col, text_col)
    rows, size = _in_blocks(placed, block_bytes)
    # a word of two bytes and more has three n-grams
    ranges = int(size // range_keys) + 1
    held_out = crc_bucket(F.col("doc_id"), FOLDS) == 0
    rows = rows.select("doc_id", "text", (~held_out).alias("train"), "block")
    asked = rows.mapInArrow(thrifty(_requests(order, ranges)), "part long, block long, keys binary, own binary")
    answers = stage(asked.groupBy("part").applyInArrow(_totals(ranges), "block long, part long, totals binary, tokens long, words long"), "answers")
    total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    schema = "doc_id long, n_tokens long, n_known long, base_sum double, score double"
    scored = (
        rows.select("block", "doc_id", "text")
        .groupBy("block")
        .cogroup(answers.select("block", "part", "totals").groupBy("block"))
        .applyInArrow(_score(order, ranges, int(total), int(distinct), strengths), schema)
    )
    floor = F.lit(float(total + 0.1 * (distinct + 1)))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.log10(floor)).alias("base_score"),
        "score",
        (F.col("score") / F.col("n_tokens")).alias("mean_score"),
    )
