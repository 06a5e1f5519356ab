"""Secret scan by a randomness test battery, in DataFrame functions only.

Base patterns (assignments, access keys, long hex) are found as such.  Beside them,
every token of 20 or more characters of ``[A-Za-z0-9+/_-]``, padding by ``=`` at its end
included, that holds a digit and a letter is a candidate; any other ``=`` parts tokens, as in
``NAME=value``.  Its encoding is inferred (hex, base32, alphanumeric, base64, at last the
union of them all, so that every candidate is tested) and three tests of randomness against that alphabet are made: chi-squared uniformity,
the runs test about the median, and lag-1 serial correlation.  The combined p-value
is three times the smallest (Bonferroni).  Tokens are not random in general; so a test's
rejection is a discovery of structure, and Benjamini-Hochberg control at level ``q``
is applied within bands of token length, since power grows with length.  Tokens that
are not rejected are reported as kind ``random``, from the shortest candidate on.

The control needs the ranks of all p-values of a band.  They are counted in bins of
-log10 p (a bounded histogram, rounded towards 1, so the control is conservative); no
task ever holds a band's tokens.

Defined cases: a null text is an empty one and has no spans; rows that repeat are each
reported (and each counts in the control); an empty table gives an empty result; other
columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataview.llm.staging import stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: '=' is padding where no other character of a token follows; a candidate has 20 characters with two of it at most.
TOKEN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?|(?:[A-Za-z0-9+/_-]{19}={1,2}|[A-Za-z0-9+/_-]{18}==)(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")

#: Inferred encodings, narrowest first: pattern and alphabet in ordinal order.
ALPHABETS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Upper ends of the length bands, and bins of -log10 p.
BANDS = (24, 32, 48, 64, 128, 512)
BIN_WIDTH, MAX_BIN = 0.05, 400


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 26.2.17; error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside lambdas Spark would evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums(token: Column, alphabet: Column) -> Column:
    """What the tests need of ``token``, in one pass over the places of its characters in ``alphabet``."""
    middle = (F.length(alphabet) + 1) / 2
    zero = F.lit(0.0)
    names = ("total", "squares", "lagged", "first", "last", "high", "turns")
    start = F.struct(*(zero.alias(x) for x in names))

    def step(s: Column, r: Column) -> Column:
        begun = s["last"] > 0  # places count from 1
        turn = begun & ((s["last"] > middle) != (r > middle))
        values = (
            s["total"] + r, s["squares"] + r * r, s["lagged"] + s["last"] * r, F.when(begun, s["first"]).otherwise(r), r,
            s["high"] + F.when(r > middle, 1.0).otherwise(0.0), s["turns"] + F.when(turn, 1.0).otherwise(0.0),
        )
        return F.struct(*(v.alias(x) for v, x in zip(values, names, strict=True)))

    return F.aggregate(F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double")), start, step)


def letter_squares(token: Column, alphabet: Column) -> Column:
    """Sum over the alphabet of the squared number of times that a letter occurs."""
    n = F.length(token).cast("double")
    return F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))


def p_values(n: Column, k: Column, squares: Column, s: Column) -> dict[str, Column]:
    """p-values of the three tests of ``n`` characters against uniform draws from ``k`` letters, from ``sums``."""
    chi2, df = squares * k / n - n, k - 1
    # Wilson and Hilferty's cube root makes chi-squared normal
    z_chi = (F.pow(F.greatest(chi2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high, runs = s["high"], 1 + s["turns"]
    expected = 2 * high * (n - high) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(spread > 0, F.abs(runs - expected) / F.sqrt(spread)).otherwise(F.lit(40.0))
    mean = s["total"] / n
    variance = s["squares"] - n * mean * mean
    lagged = s["lagged"] - mean * (2 * s["total"] - s["first"] - s["last"]) + (n - 1) * mean * mean
    z_serial = F.when(variance > 1e-6, F.abs(lagged / variance + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
    return {"chi": _upper_tail(z_chi), "runs": 2 * _upper_tail(z_runs), "serial": 2 * _upper_tail(z_serial)}


SPANS = "array<struct<start:int,kind:int,end:int,token:string>>"
#: Matches that one fold appends; a fold copies its result for every match.
FOLD = 128


def _spans(text: Column, pattern: str, kind: str, keep=None, group: Column | None = None) -> Column:
    """Array of struct(start, kind, end, token) of all matches of ``pattern``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group is None else group
    none = F.array().cast(SPANS)

    def append(acc: Column, item: Column) -> Column:
        begin = acc["at"] + F.length(item["gap"])
        end = begin + F.length(item["token"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), item["judged"].alias("token"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def spans_of(matches: Column) -> Column:
        items = F.zip_with(
            F.arrays_zip(matches.alias("token"), judged.alias("judged")),
            F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)),
            lambda m, gap: F.struct(m["token"].alias("token"), m["judged"].alias("judged"), gap.alias("gap")),
        )
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        # folds of FOLD matches, each from 0, then their shifts
        parts = once(items, lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(FOLD)), lambda at: F.aggregate(F.slice(xs, at, F.lit(FOLD)), begin, append)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("shifts"))

        def shifted(ps: Column) -> Column:
            shifts = F.aggregate(ps, zero, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["shifts"], acc["at"]).alias("shifts")))["shifts"]
            move = lambda p, by: F.transform(p["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["token"].alias("token")))
            return F.flatten(F.zip_with(ps, shifts, move))

        return once(parts, shifted)

    spans = once(found, lambda matches: F.when(F.size(matches) > 0, spans_of(matches)).otherwise(none))
    return F.filter(spans, keep) if keep is not None else spans


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(length <= BANDS[k], k).otherwise(out)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05, least: int = 0) -> DataFrame:
    """One row per document: counts and digest of the base kinds, and all spans.

    ``q`` is the false-discovery level of the structure tests, ``least`` the shortest
    token (without padding) whose randomness is reported.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    value = F.regexp_extract_all(F.col("text"), F.lit(ASSIGN), F.lit(2))
    found = rows.select(
        "doc_id",
        _spans(F.col("text"), ASSIGN, "assign", lambda s: F.length(s["token"]) >= 6, value).alias("assign"),
        _spans(F.col("text"), ACCESS, "access").alias("access"),
        _spans(F.col("text"), HEX, "hex").alias("hex"),
        _spans(F.col("text"), TOKEN, "random", lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]")).alias("random"),
    )

    def inferred(s: Column) -> Column:
        token = F.regexp_replace(s["token"], "=+$", "")
        alphabet = F.lit(None).cast("string")
        for pattern, letters in reversed(ALPHABETS):
            alphabet = F.when(s["token"].rlike(pattern.replace("$", "=*$")), F.lit(letters)).otherwise(alphabet)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), token.alias("token"), alphabet.alias("alphabet"))

    def summed(s: Column) -> Column:
        found_sums = sums(s["token"], s["alphabet"]).alias("sums")
        n, k = F.length(s["token"]).alias("n"), F.length(s["alphabet"]).alias("k")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), n, k, letter_squares(s["token"], s["alphabet"]).alias("squares"), found_sums)

    def judged(s: Column) -> Column:
        p = p_values(s["n"].cast("double"), s["k"].cast("double"), s["squares"], s["sums"])
        combined = F.least(F.lit(1.0), 3 * F.least(*p.values()))
        # rounded down: a p-value counts as the larger end of its bin
        bin_ = F.least(F.lit(MAX_BIN), F.floor(-F.log10(F.greatest(combined, F.lit(1e-300))) / BIN_WIDTH)).cast("int")
        tested = s["k"].isNotNull() & (s["n"] >= 2)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(tested, bin_).alias("bin"), _band(s["n"]).alias("band"), s["n"].alias("n"))

    found = stage(found.withColumn("random", F.transform(F.transform(F.transform("random", inferred), summed), judged)), "secret-candidates")
    counts = found.select(F.explode("random").alias("s")).where("s.bin is not null").groupBy(F.col("s.band").alias("band"), F.col("s.bin").alias("bin")).agg(F.count("*").alias("n"))
    # bounded: 7 bands of 401 bins.  Rejected: all bins from the lowest that meets p <= q * rank / m
    per_band = Window.partitionBy("band")
    ranked = counts.withColumn("rank", F.sum("n").over(per_band.orderBy(F.desc("bin")))).withColumn("m", F.sum("n").over(per_band))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * BIN_WIDTH) <= q * F.col("rank") / F.col("m"))
    cuts = passed.groupBy("band").agg(F.min("bin").alias("bin"))
    cut_map = cuts.agg(F.map_from_entries(F.collect_list(F.struct("band", "bin"))).alias("cuts"))

    def random_kept(s: Column) -> Column:
        cut = F.coalesce(F.try_element_at(F.col("cuts"), s["band"]), F.lit(MAX_BIN + 1))
        return s["bin"].isNotNull() & (s["bin"] < cut) & (s["n"] >= least)

    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    out = found.crossJoin(F.broadcast(cut_map))  # one row
    base = F.array_sort(F.transform(F.concat("assign", "access", "hex"), plain))
    every = F.array_sort(F.concat(base, F.transform(F.filter("random", random_kept), plain)))
    return out.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )
