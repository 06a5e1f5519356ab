"""Topics of documents by k-means over hashed words.

A text is the square roots of its shares of ``DIMENSIONS`` hashed word buckets, in 127ths, so that Euclidean distance is Hellinger's between word
distributions.  Clusters grow by splitting: all texts are one cluster at first; each is split along its widest
dimension, twice as many are settled by ``ROUNDS`` rounds, and so on until there are ``2 ** splits``.

Scale: a text is read once and leaves a vector of 128 bytes.  Every round covers the vectors of all documents: tasks add up whole numbers for each
cluster, which are summed by key, so the driver sees clusters x dimensions sums and the result depends neither on partitions nor on retries.

Defined cases: a text without words (or null) has topic ``none`` and moves no cluster; equal texts have equal topics; ties go to the
cluster of the smaller number; texts that differ less than a split can tell leave clusters empty; without texts there is no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataview.llm.textkit import steps, text_buffers, thrifty, word_hashes

DIMENSIONS = 128
#: Three splits give eight topics.
SPLITS = 3
#: Rounds of assignment after each split.
ROUNDS = 2
NONE = "none"
_WHOLE = 127


def word_vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (texts x DIMENSIONS, whole numbers up to 127) and words of each text."""
    n = len(offsets) - 1
    hashes, owner = word_hashes(data, offsets)
    bucket = (hashes % np.uint64(DIMENSIONS)).astype(np.int64)
    counts = np.bincount(owner * DIMENSIONS + bucket, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    words = counts.sum(axis=1)
    return np.rint(_WHOLE * np.sqrt(counts / np.maximum(words, 1)[:, None])).astype(np.uint8), words


def with_vectors(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with columns ``vector`` and ``n_tokens`` in place of the column ``text``."""
    rest = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("vector", T.BinaryType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                at = part.schema.get_field_index(text)
                vectors, words = word_vectors(*text_buffers(part.column(at)))
                whole = pa.array([v.tobytes() for v in vectors], pa.binary())
                columns = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), whole], names)

    return rows.mapInArrow(thrifty(run), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as rows of whole numbers."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(len(column), DIMENSIONS).astype(np.int64)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each vector, -1 for vectors of zeros."""
    far = (centres**2).sum(axis=1)[None, :] - 2 * (vectors @ centres.T)
    return np.where(vectors.any(axis=1), far.argmin(axis=1), -1)


def _sums(vectored: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of each cluster, and the sums of their vectors and squares by dimension."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0))
            whose = nearest(vectors, centres)
            for c in range(k):
                members = vectors[whose == c]
                n[c] += len(members)
                first[c] += members.sum(axis=0)
                second[c] += (members**2).sum(axis=0)
        at = [(c, d) for c in np.flatnonzero(n).tolist() for d in range(DIMENSIONS)]
        rows = [(c, d, int(n[c]), int(first[c, d]), int(second[c, d])) for c, d in at]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["c", "d", "n", "a", "b"])

    parts = vectored.select("vector").mapInArrow(run, "c long, d long, n long, a long, b long")
    n, first, second = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS)), np.zeros((k, DIMENSIONS))
    # at most clusters x dimensions rows, whatever the input
    for row in parts.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        n[row.c], first[row.c, row.d], second[row.c, row.d] = row.n, row.a, row.b
    return n, first, second


def _settled(centres: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one stays where it is."""
    return np.where(n[:, None] > 0, first / np.maximum(n, 1)[:, None], centres)


def split(centres: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Each centre moved both ways by the deviation along its widest dimension."""
    spread = np.sqrt(np.maximum(second / np.maximum(n, 1)[:, None] - (first / np.maximum(n, 1)[:, None]) ** 2, 0))
    widest = spread.argmax(axis=1)
    step = np.zeros_like(centres)
    step[np.arange(len(centres)), widest] = spread[np.arange(len(centres)), widest]
    return np.stack([centres - step, centres + step], axis=1).reshape(-1, DIMENSIONS)


def fit_topics(vectored: DataFrame, splits: int = SPLITS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the topics of all rows; ``vectored`` has column ``vector`` and is read once a round, so it should be staged."""
    centres = np.zeros((1, DIMENSIONS))
    n, first, second = _sums(vectored, centres)
    centres = _settled(centres, n, first)
    for _ in range(splits):
        centres = split(centres, n, first, second)
        for _ in range(rounds):
            n, first, second = _sums(vectored, centres)
            centres = _settled(centres, n, first)
    return centres


def topic_of(centres: np.ndarray, vector: Column) -> Column:
    """Name of the topic of a vector."""
    names = np.array([NONE, *(f"topic{k}" for k in range(len(centres)))])

    @F.arrow_udf("string")
    def named(column: pa.Array) -> pa.Array:
        return pa.array(names[nearest(_matrix(column), centres) + 1])

    return named(vector)
