"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed rows: the word and its prefixes of 4, 5 and 6
bytes.  Filters of widths 1, 2 and 3 slide over the embedded words of the whole text, the
largest response of each is kept, and a logistic layer gives the score.  Embeddings start
from the log-odds of their features, everything is then trained by Adam.

All labelled rows that are not held out are learned, whole texts of any length, in tasks: counts of each bucket and label
are summed over all rows for the log-odds; then in ROUNDS rounds each block of rows (about BLOCK_ROWS) trains the shared model on its own
rows, and the blocks' changes are averaged, an embedding row's over the blocks that have it, weighted by their rows (parameter
mixing).  The driver holds one model and never a text.  A fifth of the rows (by hash of the id) is kept from
training; counts of all their scores, in steps of 1/BINS of a logit, give the calibration, by which the best single threshold
is THRESHOLD, and the best threshold of each language with enough cases.  Language decides which threshold applies, never a score.

Defined cases: a null text is an empty one and gets the score of a text without
words; rows that repeat get the same score; without labels of both classes every score is 0; a label
that is null is ignored, of several labels of one id the largest counts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import crc_bucket, release, stage
from strataview.llm.textkit import free_unused, range_sums, span_hash, steps, text_buffers, thrifty, words

BUCKET_BITS, DIM = 18, 16
WIDTHS, FILTERS = (1, 2, 3), 8
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
HELD_OUT_FOLDS, HELD_OUT = 4, 2
#: Bounds of a sample for a look at the rows (``labelled_sample``); the model learns all rows.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 2500, 4500, 12_000
#: Rounds of training, passes of a block over its rows in each, texts and tokens of a step.
ROUNDS, EPOCHS, BATCH, BATCH_TOKENS, RATE = 3, 2, 64, 200_000, 0.01
#: Rows of a block, bytes of text that it holds at once, ids that may be broadcast, one of how many rows calibrates, bins of a logit.
BLOCK_ROWS, CHUNK_BYTES, BROADCAST_IDS, CHECK, BINS = 5000, 8 << 20, 1_000_000, 5, 1000
PAD = max(WIDTHS)

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True


@dataclass
class Model:
    rows: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def features(batch_data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed rows of the distinct words, every token's word number, and each text's first token.

    Punctuation at both ends of a word is dropped.  Number 0 is padding: PAD of it close every text.
    """
    data, begin, end, owner = words(batch_data, offsets)
    for _ in range(4):
        last = (end - begin > 1) & ~_ALNUM[data[end - 1]] if len(end) else np.zeros(0, bool)
        end = end - last
        first = (end - begin > 1) & ~_ALNUM[data[begin]] if len(end) else np.zeros(0, bool)
        begin = begin + first
    sums = range_sums(data)
    _, at, back = np.unique(span_hash(sums, begin, end), return_index=True, return_inverse=True)
    b, e = begin[at], end[at]
    hashed = [span_hash(sums, b, e)] + [span_hash(sums, b, np.minimum(b + p, e), salt=p) for p in PREFIXES]
    buckets = (np.stack(hashed, axis=1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64).reshape(-1, 1 + len(PREFIXES))
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts + PAD)])
    ids = np.zeros(first[-1], np.int64)
    inner = np.ones(len(ids), bool)
    for k in range(1, PAD + 1):
        inner[first[1:] - k] = False
    ids[inner] = back + 1
    return buckets, ids, first


def embed(rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Vectors of the distinct words, the padding's zeros first."""
    out = np.zeros((len(buckets) + 1, DIM), np.float32)
    for k in range(buckets.shape[1]):
        out[1:] += rows[buckets[:, k]]
    return out / np.float32(buckets.shape[1])


def responses(vectors: np.ndarray, ids: np.ndarray, first: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Responses of one width at every window start; starts in the closing padding are excluded."""
    width = len(filters)
    out = np.tile(bias, (len(ids), 1)).astype(np.float32)
    for k in range(width):
        part = vectors @ filters[k]
        out[: len(ids) - k] += part[ids[k:]]
    for k in range(1, PAD):
        out[first[1:] - k] = -np.inf
    return out


def logits(model: Model, buckets: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    vectors = embed(model.rows, buckets)
    pooled = [np.maximum.reduceat(responses(vectors, ids, first, f, b), first[:-1], axis=0) for f, b in zip(model.filters, model.bias, strict=True)]
    return np.maximum(np.concatenate(pooled, axis=1), 0) @ model.out + model.out_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.m, self.v, self.t = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.t += 1
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.99 * self.v[at] + 0.01 * grad * grad
        self.value[at] -= self.rate * (self.m[at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[at] / (1 - 0.99**self.t)) + 1e-7)


def bucket_counts(buckets: np.ndarray, ids: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Texts of each label that have each bucket."""
    owner = np.repeat(np.arange(len(label)), np.diff(first))
    pairs = np.unique(owner[ids > 0] * np.int64(len(buckets) + 1) + ids[ids > 0])
    texts, words_ = pairs // (len(buckets) + 1), pairs % (len(buckets) + 1) - 1
    held = np.unique((texts[:, None] << BUCKET_BITS) + buckets[words_])
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for y in (0, 1):
        counts[y] = np.bincount(held[label[held >> BUCKET_BITS] == y] & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
    return counts


def log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of every bucket; ``n``: texts of each label."""
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    seen = counts.sum(axis=0)
    return odds * seen / (seen + 12)


def sample_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of a chunk of texts, made step by step to keep memory low."""
    parts, n_words, n_tokens = [], 0, 0
    for step in steps(pa.RecordBatch.from_arrays([texts], ["text"])):
        buckets, ids, first = features(*text_buffers(step.column(0)))
        parts.append((buckets.astype(np.int32), np.where(ids > 0, ids + n_words, 0).astype(np.int32), first[:-1] + n_tokens))
        n_words += len(buckets)
        n_tokens += len(ids)
    buckets, ids, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    return buckets, ids, np.append(first, n_tokens)


def start(counts: np.ndarray, n: np.ndarray, seed: int = 3) -> Model:
    """The model before training."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 0.05, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    rows[:, 0] = log_odds(counts, n)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    for f, b in zip(filters, bias, strict=True):
        f[:, 0, : FILTERS // 2] = 1.0  # half of the filters start as detectors of log-odds
        b[: FILTERS // 2] = -0.5
    share = n[1] / n.sum()
    out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
    return Model(rows, filters, bias, out, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)) - 1.0))


def _batches(order: np.ndarray, tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ``order`` of at most BATCH texts and, but for longer texts, BATCH_TOKENS tokens."""
    at = 0
    while at < len(order):
        held = np.cumsum(tokens[order[at : at + BATCH]])
        end = at + max(1, int(np.searchsorted(held, BATCH_TOKENS, "right")))
        yield order[at:end]
        at = end


class Trainer:
    """A block's copy of the model, trained by Adam; ``toxic_weight``: weight of a toxic row."""

    def __init__(self, model: Model, toxic_weight: float, seed: int):
        self.model, self.toxic_weight, self.seen = model, toxic_weight, 0
        self.rows, self.filters, self.bias = model.rows.copy(), [f.copy() for f in model.filters], [b.copy() for b in model.bias]
        self.out, self.out_bias = model.out.copy(), np.array([model.out_bias], np.float32)
        self.adam_rows = _Adam(self.rows, RATE / 2)
        self.adam_f, self.adam_b = [_Adam(f, RATE) for f in self.filters], [_Adam(b, RATE) for b in self.bias]
        self.adam_o, self.adam_ob = _Adam(self.out, RATE), _Adam(self.out_bias, RATE)
        self.rng = np.random.default_rng(seed)

    def learn(self, texts: pa.Array, label: np.ndarray, epochs: int = EPOCHS) -> None:
        buckets, ids, first = sample_features(texts)
        rows, filters, bias, out, out_bias, rng = self.rows, self.filters, self.bias, self.out, self.out_bias, self.rng
        adam_rows, adam_f, adam_b, adam_o, adam_ob = self.adam_rows, self.adam_f, self.adam_b, self.adam_o, self.adam_ob
        weight = np.where(label == 1, self.toxic_weight, 1.0)
        self.seen += len(label)
        for _ in range(epochs):
            for docs in _batches(rng.permutation(len(label)), np.diff(first)):
                parts = [ids[first[d] : first[d + 1]] for d in docs]
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                own, tokens = np.unique(np.concatenate([[0], *parts]), return_inverse=True)
                tokens = tokens[1:]
                vectors = embed(rows, buckets[own[1:] - 1])
                where, pooled = [], []
                for f, b in zip(filters, bias, strict=True):
                    y = responses(vectors, tokens, starts, f, b)
                    best = np.stack([y[s:e].argmax(axis=0) + s for s, e in zip(starts[:-1], starts[1:], strict=True)])
                    where.append(best)
                    pooled.append(y[best, np.arange(FILTERS)])
                z = np.concatenate(pooled, axis=1)
                hidden = np.maximum(z, 0)
                error = ((_sigmoid(hidden @ out + out_bias[0]) - label[docs]) * weight[docs] / len(docs)).astype(np.float32)
                back = (error[:, None] * out[None, :]) * (z > 0)
                grad_v = np.zeros_like(vectors)
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grad_f = np.zeros_like(filters[k])
                    for j in range(w):
                        word = tokens[np.minimum(where[k] + j, len(tokens) - 1)]
                        grad_f[j] = np.einsum("df,dfe->ef", g, vectors[word])
                        np.add.at(grad_v, word.ravel(), (g[:, :, None] * filters[k][j].T[None]).reshape(-1, DIM))
                    adam_f[k].step(grad_f)
                    adam_b[k].step(g.sum(axis=0))
                adam_o.step(hidden.T @ error + 1e-4 * out)
                adam_ob.step(np.array([error.sum()]))
                moved = np.flatnonzero(np.abs(grad_v[1:]).sum(axis=1))
                if len(moved):
                    hit = buckets[own[1:][moved] - 1]
                    rows_at, which = np.unique(hit, return_inverse=True)
                    grad_r = np.zeros((len(rows_at), DIM), np.float32)
                    np.add.at(grad_r, which.ravel(), np.repeat(grad_v[1:][moved] / hit.shape[1], hit.shape[1], axis=0))
                    adam_rows.step(grad_r, rows_at)

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and changes of what was trained, DIM numbers a key: embedding rows, then all else in one run."""
        change = self.rows - self.model.rows
        hit = np.flatnonzero(np.abs(change).sum(axis=1))
        rest = _rest(self.filters, self.bias, self.out, float(self.out_bias[0])) - _rest(self.model.filters, self.model.bias, self.model.out, self.model.out_bias)
        return np.concatenate([hit, (1 << BUCKET_BITS) + np.arange(len(rest))]), np.concatenate([change[hit], rest])


def _rest(filters: list[np.ndarray], bias: list[np.ndarray], out: np.ndarray, out_bias: float) -> np.ndarray:
    flat = np.concatenate([*(f.ravel() for f in filters), *bias, out, [out_bias]]).astype(np.float32)
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def changed(model: Model, keys: np.ndarray, change: np.ndarray) -> Model:
    """``model`` with the changes added."""
    own = keys < (1 << BUCKET_BITS)
    rows = model.rows.copy()
    rows[keys[own]] += change[own]
    rest = _rest(model.filters, model.bias, model.out, model.out_bias)
    rest[keys[~own] - (1 << BUCKET_BITS)] += change[~own]
    flat, at = rest.ravel(), 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return flat[at - like.size : at].reshape(like.shape).copy()

    return Model(rows, [take(f) for f in model.filters], [take(b) for b in model.bias], take(model.out), float(flat[at]))


def best_threshold(score: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Threshold of the largest F1, half-way to the next score below, from counts of both labels by distinct score."""
    order = np.argsort(-score)
    s, hit, miss = score[order], np.cumsum(toxic[order]), np.cumsum(clean[order])
    f1 = 2 * hit / np.maximum(hit + miss + hit[-1], 1e-9)
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def calibrate(model: Model, x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
    """Slope and shift of the scores, from counts of both labels by logit."""
    slope, shift, n = 1.0, 0.0, toxic.sum() + clean.sum()
    for _ in range(300):  # Platt scaling with pulled-in targets
        p = _sigmoid(slope * x + shift)
        error = toxic * (p - 0.99) + clean * (p - 0.01)
        slope -= 0.05 * float((error * x).sum() / max(((toxic + clean) * x * x).sum(), 1e-9)) * 4
        shift -= 0.2 * float(error.sum() / n)
    slope = max(slope, 0.05)
    model.slope, model.shift = slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * best_threshold(x, toxic, clean))


def known_labels(labels: DataFrame) -> DataFrame:
    """(__id, __toxic) of the labelled ids that are not held out; an id is toxic if one of its labels says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__toxic is not null and __id is not null")
    return known.where(crc_bucket(F.col("__id"), HELD_OUT_FOLDS) != HELD_OUT).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled ids that are not held out, staged: __id, text, lang, toxic (0 or 1), block, check.

    Of several texts of an id the last in order is learned.  Up to BROADCAST_IDS ids (counted) are broadcast, so that only their texts are shuffled.
    """
    known = known_labels(labels)
    n = known.count()
    blocks = -(-max(n, 1) // BLOCK_ROWS)
    rows = _texts(docs).where(crc_bucket(F.col("__id"), HELD_OUT_FOLDS) != HELD_OUT)
    if n <= BROADCAST_IDS:
        joined = rows.join(F.broadcast(known), "__id").repartition(blocks, "__id")
    else:
        joined = rows.repartition(blocks, "__id").join(known.repartition(blocks, "__id"), "__id")
    own = joined.groupBy("__id").agg(F.max(F.struct("text", "lang")).alias("own"), F.max("__toxic").alias("__toxic"))
    block = F.pmod(F.hash("__id"), F.lit(blocks))  # as Spark deals them, so a partition is a block
    check = F.pmod(F.xxhash64("__id"), F.lit(CHECK)) == 0
    return stage(own.select("__id", "own.text", "own.lang", (F.col("__toxic") > 0).cast("int").alias("toxic"), block.alias("block"), check.alias("check")), "labelled")


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_bytes: int = FIT_BYTES) -> tuple[pa.Table, float]:
    """A bounded sample (text, lang, toxic) for a look at the labelled rows, and the share of toxic ids among all labelled.

    Nothing is learned from it: the model sees ``labelled_rows``.
    """
    known = known_labels(labels)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("__toxic") > 0, 1).otherwise(0)), F.lit(0))).first()
    order = F.xxhash64("__id")
    picked = known.where("__toxic > 0").orderBy(order, "__id").limit(fit_toxic).unionByName(known.where("__toxic <= 0").orderBy(order, "__id").limit(fit_clean))
    rows = _texts(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= fit_bytes)
    # the ids are at most fit_toxic + fit_clean
    own = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.max(F.struct("text", "lang")).alias("own"), F.max("__toxic").alias("toxic"))
    sample = own.select("__id", "own.text", "own.lang", "toxic")
    return sample.toArrow().sort_by("__id"), float(toxic) / max(n, 1)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model | None = model.value
        for whole in batches:
            for batch in steps(whole):
                score = np.zeros(batch.num_rows)
                if fitted is not None:
                    x = logits(fitted, *features(*text_buffers(batch.column(1))))
                    score = _sigmoid(fitted.slope * x.astype(np.float64) + fitted.shift)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64())], ["doc_id", "lang", "__score"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each bucket and label in a task."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for whole in batches:
        for batch in steps(whole):
            counts += bucket_counts(*features(*text_buffers(batch.column(0))), batch.column(1).to_numpy())
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["key", "n0", "n1"])


def _trained(model, toxic_weight: float, turn: int):
    """Changes of the shared model by each block of a task, times the block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer: Trainer | None = None
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            keys, change = trainer.changes()
            change = change.astype(np.float64) * trainer.seen
            columns = [pa.array(keys.astype(np.int32)), pa.array(np.full(len(keys), trainer.seen, np.int64)), *(pa.array(np.ascontiguousarray(change[:, k])) for k in range(DIM))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", *(f"d{k}" for k in range(DIM))])

        for whole in batches:
            for batch in steps(whole, limit=CHUNK_BYTES):
                blocks = batch.column(2).to_numpy()
                for block in np.unique(blocks).tolist():
                    if block != at:
                        if trainer is not None:
                            yield from done()
                        trainer, at = Trainer(model.value, toxic_weight, turn * 1_000_003 + block), block
                    own = pa.array(blocks == block)
                    trainer.learn(batch.column(0).filter(own), batch.column(1).filter(own).to_numpy())
        if trainer is not None:
            yield from done()

    return run


def _binned(model):
    """Language, label and binned logit of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                x = logits(model.value, *features(*text_buffers(batch.column(0))))
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(np.rint(x.astype(np.float64) * BINS).astype(np.int64))], ["lang", "toxic", "bin"])

    return run


def fitted_model(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all labelled rows that are not held out; None without rows of both labels."""
    context = docs.sparkSession.sparkContext
    rows = labelled_rows(docs, labels)
    n = np.zeros((2, 2), np.int64)
    for r in rows.groupBy("check", "toxic").count().collect():
        n[int(r["check"]), r["toxic"]] = r["count"]
    if not n.sum(axis=0).all():
        return None
    apart = n.all()  # else too few rows for a part of its own
    learn, check = (rows.where(~F.col("check")), rows.where("check")) if apart else (rows, rows)
    n = n[0] if apart else n.sum(axis=0)
    found = learn.select("text", "toxic").mapInArrow(thrifty(_counted), "key int, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for y in (0, 1):
        counts[y, found["key"].to_numpy()] = found[f"n{y}"].to_numpy()
    model = start(counts, n)
    weight = float((n[0] / n[1]) ** 0.5)
    names = [f"d{k}" for k in range(DIM)]
    for turn in range(ROUNDS):
        shared = context.broadcast(model)
        parts = learn.select("text", "toxic", "block").mapInArrow(thrifty(_trained(shared, weight, turn)), f"key int, n long, {', '.join(f'{d} double' for d in names)}")
        # at most a row for each row of the model
        mean = parts.groupBy("key").agg(*((F.sum(d) / F.sum("n")).cast("float").alias(d) for d in names)).toArrow()
        model = changed(model, mean["key"].to_numpy(), np.stack([mean[d].to_numpy() for d in names], axis=1))
        shared.destroy()
    shared = context.broadcast(model)
    binned = check.select("text", "toxic", "lang").mapInArrow(thrifty(_binned(shared)), "lang string, toxic int, bin long")
    binned = stage(binned.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")), "scores")
    every = binned.groupBy("bin").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()  # at most as many as bins
    calibrate(model, every["bin"].to_numpy() / BINS, every["n1"].to_numpy(), every["n0"].to_numpy())
    slope, shift = model.slope, model.shift

    def threshold(table: pa.Table) -> pa.Table:
        toxic, clean = table["n1"].to_numpy(), table["n0"].to_numpy()
        if toxic.sum() < 25 or clean.sum() < 25:
            return pa.table({"lang": pa.array([], pa.string()), "cut": pa.array([], pa.float64())})
        return pa.table({"lang": table["lang"].slice(0, 1), "cut": [best_threshold(_sigmoid(slope * (table["bin"].to_numpy() / BINS) + shift), toxic, clean)]})

    model.thresholds = {r["lang"]: r["cut"] for r in binned.groupBy("lang").applyInArrow(threshold, "lang string, cut double").orderBy("lang").collect()}
    shared.destroy()
    for staged in (rows, binned):
        release(staged)
    free_unused()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, threshold, flagged."""
    spark = docs.sparkSession
    model = fitted_model(docs, labels)
    shared = spark.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    scored = rows.mapInArrow(thrifty(_score(shared)), "doc_id long, lang string, __score double")
    threshold = F.lit(THRESHOLD)
    for name, cut in (model.thresholds if model else {}).items():
        threshold = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(cut)).otherwise(threshold)
    return scored.select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("__score") >= threshold).alias("flagged"),
    )


def _keep(model):
    """Rows of all columns whose score is below their language's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for whole in batches:
            names = whole.schema.names
            for batch in steps(whole):
                x = logits(fitted, *features(*text_buffers(batch.column(names.index("text")))))
                score = _sigmoid(fitted.slope * x.astype(np.float64) + fitted.shift)
                lang = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * batch.num_rows
                cut = np.array([fitted.thresholds.get(k or "", THRESHOLD) for k in lang])
                yield batch.filter(pa.array(score < cut))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not flagged, with all their columns."""
    model = fitted_model(docs, labels)
    if model is None:
        return docs
    return docs.mapInArrow(thrifty(_keep(docs.sparkSession.sparkContext.broadcast(model))), docs.schema)
