"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, schemes and identifier cues.  A deterministic local parser per kind
expands from an anchor to the left and right and validates what it finds; after
a match (or a failing one that is used up) anchors inside it are passed over.

Base kinds, leftmost and non-overlapping per kind: email, ip (parts up to 255), card
(14 to 19 digits, Luhn), phone (10 to 15 digits).  The method adds: ``iban`` (cue
``iban``, mod-97 checked), ``account`` (an account cue and 6 to 20 digits) and
``userinfo`` (credentials in a URL's authority).

Defined cases: a null text is an empty one and has no spans; rows that repeat are
each reported; an empty table gives an empty result; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.textkit import text_array

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "account", "userinfo")
KINDS = (*BASE, *EXTRA)
_RANK = {k: i for i, k in enumerate(KINDS)}

CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:#=.-]{0,4}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|num))?[\x20:#=.]{1,4}([0-9][0-9-]{4,24}[0-9])(?![0-9A-Za-z])")
_USERINFO = re.compile(r"([^\s/@:?#]+(?::[^\s/@?#]*)?)@[A-Za-z0-9-]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    total += sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "").upper()
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def make_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "d") for d in "0123456789"), *((s, "s") for s in SCHEMES), *((c, "c") for c in CUES)]:
        auto.add_word(word, (kind, word))
    auto.make_automaton()
    return auto


_automaton = None
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, by start, then kind as listed."""
    global _automaton
    if _automaton is None:
        _automaton = make_automaton()
    found: list[tuple[int, int, str, int]] = []
    after = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    chain_end = dotted_end = 0

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, _RANK[kind], kind, end))

    for last, (anchor, word) in _automaton.iter(text.translate(_UPPER)):
        if anchor == "d":
            if last >= chain_end:
                if m := _CHAIN.match(text, last):
                    chain_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        add("card", last, chain_end)
                else:
                    chain_end = last + 1
            if last >= dotted_end:
                m = _DOTTED.match(text, last)
                dotted_end = m.end()
                parts, at = m[0].split("."), last
                for k in range(0, len(parts) - 3, 4):
                    end = at + sum(map(len, parts[k : k + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[k : k + 4]):
                        add("ip", at, end)
                    at = end + 1
        elif anchor == "@":
            start, least = last, after["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                add("email", start, m.end())
                after["email"] = m.end()
        elif anchor == "+":
            if last >= after["phone"] and (m := _PHONE.match(text, last)):
                after["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", last, m.end())
        elif anchor == "s":
            if m := _USERINFO.match(text, last + 1):
                add("userinfo", *m.span(1))
        elif word == "iban":
            if last >= after["iban"] and (m := _IBAN.match(text, last + 1)) and mod97(m[1]):
                add("iban", *m.span(1))
                after["iban"] = m.end()
        elif last >= after["account"] and (last == len(word) - 1 or not text[last - len(word)].isalnum()):
            if (m := _ACCOUNT.match(text, last + 1)) and 6 <= len(m[1].replace("-", "")) <= 20:
                add("account", *m.span(1))
                after["account"] = m.end()
    found.sort()
    return [(start, kind, end) for start, _, kind, end in dict.fromkeys(found)]


def span_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in text_array(batch.column(1)):
            spans = find_spans(text.as_py())
            base = [s for s in spans if s[1] in BASE]
            counts = [sum(s[1] == kind for s in base) for kind in BASE]
            rows.append((*counts, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)
