"""Queries of this subpackage: name to function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataview.llm.bpe import encoded_digests
from strataview.llm.conversations import damage, repair, reports
from strataview.llm.decontaminate import find_contamination
from strataview.llm.exact_dedup import exact_dedup
from strataview.llm.jaccard_join import jaccard_join
from strataview.llm.mixing import mix_sources
from strataview.llm.ngram_lm import score_documents
from strataview.llm.pii import find_pii
from strataview.llm.repeats import remove_repeats
from strataview.llm.secrets import scan_secrets
from strataview.llm.spelling import group_variants
from strataview.llm.staging import read_documents, small_batches
from strataview.llm.toxicity import score_toxicity
from strataview.llm.warc import round_trip


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mix_sources(read_documents(spark, sf_dir), topics_by="words")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score_documents(read_documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_documents(spark, sf_dir))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_documents(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return reports(repair(damage(read_documents(spark, sf_dir, "conversations")), F.col("gone")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return group_variants(read_documents(spark, sf_dir), damage=31)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return encoded_digests(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_toxicity, op3_ngram_lm, op4_secrets, op5_exact_dedup, op6_decontamination, op7_jaccard_join, op8_repeats, op9_pii, op10_warc, op11_conversations, op12_spelling, op13_bpe)
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
          FROM documents)
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha AS text_sha256
        FROM (SELECT doc_id, sha,
                     first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY sha) AS group_size
              FROM t)
    """,
    # links by shared shingles, then everything that is reachable; texts are compared, not hashes
    "op7_jaccard_join": r"""
        WITH RECURSIVE t AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        s AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams
          FROM t),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        e AS (
          SELECT a.doc_id AS x, b.doc_id AS y
          FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n
          HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r AS (
          SELECT doc_id, doc_id AS other FROM documents
          UNION
          SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
        SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, c.component_id
        FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
    """,
    # 40 hexadecimal digits are 32 of base32: five of the one are four of the other
    "op10_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
                     list_transform(range(8), lambda k: ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT) AS parts FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q
    """,
    # crc32 by its table of 256 entries, made from the polynomial; near words as pairs
    "op12_spelling": r"""
        WITH RECURSIVE crc AS (
          SELECT list_transform(range(256), lambda b: list_reduce(range(8),
                   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS entries),
        runs AS (
          SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS bytes
          FROM (SELECT doc_id, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
          WHERE length(run) >= 7
          GROUP BY doc_id, run),
        hashed AS (
          SELECT run, n, xor(list_reduce(list_transform(range(length(bytes) // 2), lambda k: ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT),
                   lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h
          FROM runs, crc),
        v AS (
          SELECT word, sum(n)::BIGINT AS n
          FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 7
          GROUP BY word HAVING sum(n) >= 2),
        cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM v),
        wild AS (SELECT word, n, place, substr(word, 1, place - 1) AS head, substr(word, place + 1) AS tail FROM cut),
        shorter AS (SELECT DISTINCT w.word AS long, w.n AS long_n, v.word AS short, v.n AS short_n FROM wild w JOIN v ON v.word = w.head || w.tail),
        near AS (
          SELECT a.word, a.n, b.word AS other, b.n AS other_n
          FROM wild a JOIN wild b ON a.place = b.place AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
          UNION ALL SELECT long, long_n, short, short_n FROM shorter
          UNION ALL SELECT short, short_n, long, long_n FROM shorter),
        best AS (
          SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        forms AS (
          SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
          FROM v LEFT JOIN best ON v.word = best.word),
        led AS (
          SELECT word, word AS root, form AS ahead FROM forms
          UNION ALL SELECT led.word, forms.word, forms.form FROM led JOIN forms ON led.ahead = forms.word)
        SELECT f.word, f.n, f.n_near, f.form, f.form_n, led.root
        FROM forms f JOIN led ON f.word = led.word AND led.ahead IS NULL
    """,
}
