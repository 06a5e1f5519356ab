"""BPE encoding and decoding with a public tokenizer file.

The file (a JSON of vocabulary, merges, normaliser and splitting pattern) is read once on the driver from a path that is
a parameter, and sent to the workers, its size being that of one vocabulary and checked.  A text is cut at the special
tokens' strings, normalised, lower-cased and split into words by the file's own pattern.
A word's parts are then merged in place: an array holds the parts between boundaries and beside it the rank of
each part joined with the next; the least rank is looked for by a scan, its boundary is deleted, and the two ranks
next to it are looked up again.  Words that are new to a batch are scanned together, a word a row.  A scan per merge costs the
square of a word's length, so words of more than ``SHORT`` bytes keep their ranks in a heap instead, with the same order (rank, then place).

Words recur, so the ids of up to ``KEPT`` of them are kept by a worker while it runs.  No rows are shuffled, and a
task holds one Arrow batch; a long text is split in parts that end at white space.

Defined cases: a null text is an empty one and has no tokens; texts of any length are encoded whole; repeated rows
are encoded each; a table without rows gives none; other columns are ignored.  An id outside the vocabulary decodes to nothing;
null ids decode to "".
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataview.llm.textkit import steps, text_array, thrifty

#: Longest word, in bytes, whose ranks are scanned; words of similar widths are scanned together, at most ``ROWS`` at a time.
WIDTHS = (4, 8, 12, 16, 24, 40, 64)
SHORT, ROWS = WIDTHS[-1], 20_000
#: Words whose ids a worker keeps; characters, or words, that are handled at once.
KEPT, STEP = 200_000, 500_000
#: Bytes of a tokenizer file that is sent to the workers.
FILE_BYTES = 64 << 20
#: Below these code points the Unicode tables of Python and of the tokenizers library agree on composition, case and category.
STRANGE = re.compile("[\u0558-\U0010ffff]")
NONE = 1 << 60
#: Bits of an id in the key of a pair.
SHIFT = 24
SPACE = regex.compile(r"[\t-\r ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(0x100 + k) for k, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every start, ``counts`` of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Vocabulary:
    """What encoding needs of a tokenizer file."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        names = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
        split = [x for x in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        ids: dict[str, int] = model.get("vocab", {})
        symbols, end = byte_symbols(), model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or names != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or file.get("decoder") or any(x not in ids or x + end not in ids for x in symbols):
            raise ValueError("not a lower-casing BPE tokenizer with all byte symbols, a split pattern and no decoder")
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
            raise ValueError("special tokens must match literally")
        self.text, self.library = text, None
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(split[0]["pattern"]["Regex"])
        self.byte_of = {symbol: byte for byte, symbol in enumerate(symbols)}
        #: Ids of a byte within a word and at its end.
        self.inner, self.last = (np.array([ids[x + e] for x in symbols], np.int64) for e in ("", end))
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        keys = np.array([ids[a] << SHIFT | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in pairs], np.int64)
        size = max([*ids.values(), *self.special.values()]) + 1
        names = [None] * size
        for token, i in (ids | self.special).items():
            names[i] = token
        self.tokens = pa.array(names, pa.string())
        self.forget()

    def __reduce__(self):
        return Vocabulary, (self.text,)

    def forget(self) -> None:
        """Start anew with the words whose ids are kept: number of a word, then its ids from ``starts`` on."""
        self.kept: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours, ``NONE`` where there is no merge."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        sizes = np.array([len(w) for w in words])
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in zip((0, *WIDTHS), WIDTHS, strict=False):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(chosen), ROWS):
                part = chosen[at : at + ROWS]
                tokens, counts[part] = self._scanned([words[k] for k in part.tolist()], sizes[part], high)
                parts.append((part, tokens[np.arange(high) < counts[part, None]]))
        for k in np.flatnonzero(sizes > SHORT).tolist():
            ids = np.array(self._heaped(words[k]))
            counts[k] = len(ids)
            parts.append((np.array([k]), ids))
        starts = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), np.int32)
        for part, ids in parts:
            out[spread(starts[part], counts[part])] = ids
        return out, counts

    def _scanned(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts of words of at most ``width`` bytes, a word a row, and how many are left in each."""
        inside = np.arange(width) < sizes[:, None]
        data = np.zeros(inside.shape, np.uint8)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        tokens = self.inner[data]
        rows = np.arange(len(words))
        tokens[rows, sizes - 1] = self.last[data[rows, sizes - 1]]
        near = np.full(inside.shape, NONE)
        joined = inside[:, 1:]
        near[:, :-1][joined] = self.rank(tokens[:, :-1][joined], tokens[:, 1:][joined])
        counts, columns = sizes.copy(), np.arange(width)
        while len(rows):
            at = near[rows].argmin(axis=1)  # the first of the least ranks
            least = near[rows, at]
            going = least < NONE
            rows, at, least = rows[going], at[going], least[going]
            if not len(rows):
                break
            # the boundary after part ``at`` goes: later parts and ranks move up
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            part, rank = np.take_along_axis(tokens[rows], moved, 1), np.take_along_axis(near[rows], np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
            part[np.arange(len(rows)), at] = self.merged[least]
            tokens[rows] = part
            counts[rows] -= 1
            rank[:, -1] = NONE
            k = np.arange(len(rows))
            after = at + 1 < counts[rows]
            rank[k, at] = NONE
            rank[k[after], at[after]] = self.rank(part[k[after], at[after]], part[k[after], at[after] + 1])
            before = at > 0
            rank[k[before], at[before] - 1] = self.rank(part[k[before], at[before] - 1], part[k[before], at[before]])
            near[rows] = rank
        return tokens, counts

    def _heaped(self, word: bytes) -> list[int]:
        parts = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]

        def merge(a: int, b: int) -> tuple[int, int] | None:
            key = a << SHIFT | b
            at = int(np.searchsorted(self.keys, key))
            return (int(self.ranks[at]), int(self.merged[self.ranks[at]])) if at < len(self.keys) and self.keys[at] == key else None

        return merged_long(parts, merge)

    def split(self, run: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, in bounded lists."""
        at = 0
        while at < len(run):
            end = at + STEP
            if end < len(run):
                space = SPACE.search(run, end)
                end = space.start() if space else len(run)
            part, at = run[at:end], end
            if not STRANGE.search(part):
                # a capital sigma is lower-cased by itself, without regard to the end of a word
                yield self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                continue
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.text)
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            yield [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in words]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words whose ids are kept from now on."""
        new = set(words).difference(self.kept)
        if self.kept and len(self.kept) + len(new) > KEPT:
            self.forget()
            new = set(words)
        if new:
            names = list(new)
            first = len(self.kept)
            # a special token goes by its string after a blank, which no word holds
            names.sort(key=lambda w: w[0] == " ")
            special = np.array([self.special[w[1:]] for w in names if w[0] == " "], np.int32)
            ids, counts = self.merge([w.encode() for w in names if w[0] != " "])
            self.flat = np.concatenate([self.flat, ids, special])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([counts, np.ones(len(special), np.int64)]))])
            self.kept.update(zip(names, range(first, first + len(names)), strict=True))
        return np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> pa.Array:
        """The ids of each text."""
        out, sizes = [], []
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if held:
                number = self.numbers(held)
                starts = self.starts[number]
                counts = self.starts[number + 1] - starts
                out.append(self.flat[spread(starts, counts)])
                count, at = np.concatenate([[0], np.cumsum(counts)]), 0
                for k, n in owners:
                    sizes[k] += int(count[at + n] - count[at])
                    at += n
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            sizes.append(0)
            for run in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
                for words in [[" " + run]] if run in self.special else self.split(run):
                    held.extend(words)
                    owners.append((k, len(words)))
                    if len(held) > STEP:
                        flush()
        flush()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The tokens' strings of each list of ids, joined by a blank."""
        values = ids.flatten()
        known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(self.tokens)))
        names = self.tokens.take(pc.if_else(known, values, pa.scalar(None, values.type)))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
        if names.null_count:
            there = names.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
            names = names.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), " ")


def merged_long(parts: list[int], merge: Callable[[int, int], tuple[int, int] | None]) -> list[int]:
    """The ids of a word of any length: the least (rank, place) comes from a heap; ``merge`` gives rank and id of a pair."""
    n = len(parts)
    tokens: list[int | None] = [*parts]
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(found[0], k) for k in range(n - 1) if (found := merge(parts[k], parts[k + 1]))]
    heapq.heapify(heap)
    while heap:
        rank, at = heapq.heappop(heap)
        end = after[at] if tokens[at] is not None else n
        found = merge(tokens[at], tokens[end]) if end < n else None
        if found is None or found[0] != rank:
            continue
        tokens[at], tokens[end] = found[1], None
        after[at] = after[end]
        if after[at] < n:
            before[after[at]] = at
        for a in (before[at], at):
            if a >= 0 and after[a] < n and (new := merge(tokens[a], tokens[after[a]])):
                heapq.heappush(heap, (new[0], a))
    return [t for t in tokens if t is not None]


def _send(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for all workers; one of them keeps it, with the pieces it has seen, as long as it runs."""
    with open(path, encoding="utf-8") as file:
        text = file.read(FILE_BYTES + 1)
    if len(text) > FILE_BYTES:
        raise ValueError("the tokenizer file is too large to be sent to every worker")
    return spark.sparkContext.broadcast(Vocabulary(text))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text; special tokens are found in the text, none are added."""
    shared = _send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in steps(batch):
                ids = vocabulary.encode(text_array(part.column(1)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(thrifty(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column ``decoded``: the tokens' strings, joined by a space as there is no decoder."""
    shared = _send(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = vocabulary.decode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(thrifty(run), "doc_id long, ids array<int>, decoded string")


def ids_text(ids: Column) -> Column:
    return F.concat_ws(" ", ids.cast("array<string>"))


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of what they decode to."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
