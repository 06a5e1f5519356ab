"""Grouping of spelling variants, without a pair of words ever being made.

Words are the runs of letters of all texts with their number of occurrences.  Two are near if they differ by exactly
one replaced, inserted or deleted code point.  Every word of the vocabulary goes to

* a wildcard group for each of its positions, (position, prefix, suffix), written as the word with ``WILDCARD`` there:
  of a group its size and its two most frequent words decide what each member's best other word is;
* a group for each word that deleting one of its code points gives (of a run of equal ones the first only, so no
  word comes twice): if the vocabulary holds that word, it is the group's centre.  A member is near to the centre alone.

Both kinds of groups are keyed by one string, so one shuffle and one sorted pass do it; size and top two are
running values of a window.  What goes on is one row a word and group in which it has a near word; these are summed.

Scale: a word of length n makes 2 n + 1 rows, and a group holds as many words as there are letters (about
120; times the positions for a deletion group), so no group grows with the input.  Occurrences are counted in tasks before they are
shuffled, by dictionaries of bounded size.  Chains of forms end after few steps, as every step has ``FACTOR`` times the occurrences;
they are followed by doubling.

Defined cases: a null text has no words, a null id counts as an empty one in the damage; ties go to the
word that is first in code-point order; repeated rows count as often as they occur; a table without rows or a vocabulary
without words gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataview.llm.staging import release, stage
from strataview.llm.textkit import text_array, thrifty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: A form occurs at least so many times as often as its word.
FACTOR = 10
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Stands for any one letter; no letter itself.
WILDCARD = "*"


def damaged(run: str, start: int, modulus: int) -> str:
    """The run without one code point if its crc, begun from ``start``, is a multiple of ``modulus``."""
    h = zlib.crc32(run.encode(), start)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of at least ``least`` letters, and how often they occur in all texts.

    ``damage``: a run of a document whose crc32 of ``<id>:<run>`` is a multiple of it loses a code point first.
    """

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_array(batch.column(1))
            for k, doc in enumerate(ids):
                found = Counter(RUN.findall(texts[k].as_py().translate(LOWER)))
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in found.items():
                    if len(word) >= least:
                        if damage:
                            word = damaged(word, start, damage)
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) >= HELD:
                    yield flush(total)
                    total = Counter()
        if total:
            yield flush(total)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(thrifty(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(vocabulary: DataFrame, least: int = 1) -> DataFrame:
    """(word, n_near, near, near_n): how many words are near, and the most frequent of them; words with none are left out.

    No word of the vocabulary has fewer than ``least`` letters."""
    word = F.col("word")
    letters = lambda i: F.substring(word, i, F.lit(1))
    left, right = lambda i: F.substring(word, F.lit(1), i - 1), lambda i: F.substring(word, i + 1, F.length(word))
    places = F.sequence(F.lit(1), F.length(word))
    replaced = F.transform(places, lambda i: F.struct(F.concat(left(i), F.lit(WILDCARD), right(i)).alias("key"), F.lit(2).alias("kind")))
    first = F.filter(places, lambda i: (i == 1) | (letters(i) != letters(i - 1)))
    deleted = F.transform(first, lambda i: F.struct(F.concat(left(i), right(i)).alias("key"), F.lit(1).alias("kind")))
    itself = F.array(F.struct(word.alias("key"), F.lit(0).alias("kind")))
    deleted = F.when(F.length(word) > least, deleted).otherwise(F.array().cast("array<struct<key:string,kind:int>>"))
    rows = vocabulary.select("word", "n", F.inline(F.concat(itself, deleted, replaced)))

    group = Window.partitionBy("key")
    order = group.orderBy("kind", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("kind", "n", "word")
    rows = rows.select("word", "kind", F.count("*").over(order).alias("size"), F.first(member).over(order).alias("top"), F.nth_value(member, 2).over(order).alias("second"))
    centre = F.col("top.kind") == 0
    best = F.when(F.col("kind") == 1, F.when(centre, F.col("top"))).when(F.col("kind") == 0, F.col("second")).otherwise(F.when(F.col("top.word") == word, F.col("second")).otherwise(F.col("top")))
    count = F.when(F.col("kind") == 1, F.lit(1)).otherwise(F.col("size") - 1)
    rows = rows.where("size > 1").select("word", count.cast("long").alias("near"), best.alias("best")).where("best is not null")
    out = rows.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word"))).alias("best"))
    return out.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form): the last word that following forms leads to.

    A step of doubling replaces the root by the root's root; steps end when no root has a form.
    """
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("__word"), F.col("root").alias("__ahead"))
        joined = found.join(ahead, F.col("root") == F.col("__word"), "left")
        if joined.where("__ahead is not null").limit(1).count() == 0:
            return found
        old, found = found, stage(joined.select("word", F.coalesce("__ahead", "root").alias("root")), "roots")
        release(old)


def group_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, factor: int = FACTOR, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of at least ``least`` letters and ``occurrences``.

    ``form``: the near word that occurs most often, if ``factor`` times as often as the word; ``root``: where forms lead.
    """
    vocabulary = stage(count_words(docs, least, damage, id_col, text_col).where(F.col("n") >= occurrences), "vocabulary")
    near = near_words(vocabulary, least)
    is_form = F.col("near_n") >= factor * F.col("n")
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    words = stage(words, "words")
    led = roots(words.where("form is not null"))
    return words.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
