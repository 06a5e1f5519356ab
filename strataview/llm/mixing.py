"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed over the cells (source, language, topic).  Raking scales
the cells until every marginal meets its target, with the rule that no cell may be
asked for more tokens than it has (its documents are then all kept).  A document is
kept with its cell's probability, decided by a hash of its id, or of its text where it has none.

Targets are shares: given as dicts, or tempered from the data (share ``** temperature``,
normalised).  Topics: column ``topic`` if the documents have one, else the form of the text:
``table``, ``symbols``, ``numeric``, ``long`` or ``prose``; with ``topics_by="words"`` clusters of words over all documents (``topics``).

Cells are collected to the driver when they are at most ``max_cells``; beyond that
the same raking runs as DataFrame aggregations.  Both ways give the same weights.

Defined cases: a null source, language or topic is a category of its own
(``\\x00null``); a null text has no tokens and is never asked for, but has its cell's
probability; rows that repeat are decided alike, and rows without id by their texts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import stage
from strataview.llm.topics import fit_topics, topic_of, with_vectors

MARGINS = ("source", "lang", "topic")
NULL = "\x00null"
#: Temperatures of the target marginals where no shares are given.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SAMPLE_SHARE = 0.5
MAX_CELLS = 200_000
ROUNDS = 60


def form_topic(text: Column) -> Column:
    """Topic by the form of the whole text."""
    n = F.greatest(F.length(text), F.lit(1))
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#$%&*<>{}", ""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return F.when(bars * 50 >= n, "table").when(symbols * 20 >= n, "symbols").when(digits * 25 >= n, "numeric").when(n > 4000, "long").otherwise("prose")


def tempered(tokens: pd.Series, temperature: float) -> pd.Series:
    share = (tokens / max(tokens.sum(), 1)).clip(lower=0) ** temperature
    share[tokens <= 0] = 0
    return share / max(share.sum(), 1e-300)


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series], budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """Tokens asked of each cell: marginals meet ``targets``, no cell above its tokens."""
    have = cells["tokens"].to_numpy(float)
    want = have * (budget / max(have.sum(), 1e-300))
    for _ in range(rounds):
        for margin, target in targets.items():
            now = pd.Series(want).groupby(cells[margin].to_numpy()).sum()
            goal = target.reindex(now.index).fillna(0) * budget
            factor = (goal / now.where(now > 0)).fillna(0)
            want = np.minimum(want * factor.reindex(cells[margin]).to_numpy(), have)
    return want


def rake_cells(cells: DataFrame, given: dict | None, share: float, max_cells: int = MAX_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """Cells with column ``probability``; ``cells`` is staged and has column ``tokens``."""
    given = given or {}
    if cells.limit(max_cells + 1).count() <= max_cells:
        local = cells.toPandas()
        targets = {}
        for margin in MARGINS:
            sums = local.groupby(margin)["tokens"].sum()
            if margin in given:
                fixed = pd.Series(given[margin], dtype=float)
                targets[margin] = fixed / fixed.sum()
            else:
                targets[margin] = tempered(sums.astype(float), TEMPERATURES[margin])
        want = rake(local, targets, share * float(local["tokens"].sum()), rounds)
        local["probability"] = np.where(local["tokens"] > 0, want / local["tokens"].clip(lower=1), share).clip(0, 1)
        return cells.sparkSession.createDataFrame(local, "source string, lang string, topic string, tokens long, probability double")

    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    budget = share * total
    goals = {}
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
        if margin in given:
            fixed = pd.Series(given[margin], dtype=float)
            pairs = [(k, float(v)) for k, v in (fixed / fixed.sum() * budget).items()]
            goals[margin] = spark.createDataFrame(pairs, f"{margin} string, goal double")
        else:
            power = F.when(F.col("t") > 0, F.pow(F.col("t") / max(total, 1.0), F.lit(TEMPERATURES[margin]))).otherwise(0.0)
            sums = stage(sums.withColumn("power", power), "margin")
            norm = max(float(sums.agg(F.sum("power")).first()[0] or 0), 1e-300)
            goals[margin] = sums.select(margin, (F.col("power") / norm * budget).alias("goal"))
    out = cells.withColumn("want", F.col("tokens") * (budget / max(total, 1e-300)))
    for _ in range(rounds):
        for margin in MARGINS:
            now = out.groupBy(margin).agg(F.sum("want").alias("now")).join(goals[margin], margin, "left")
            factor = now.select(margin, F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("factor"))
            out = out.join(factor, margin).withColumn("want", F.least(F.col("want") * F.col("factor"), F.col("tokens").cast("double"))).drop("factor")
        out = stage(out, "raked")
    return out.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.least(F.col("want") / F.greatest("tokens", F.lit(1)), F.lit(1.0))).otherwise(share).alias("probability"))


def uniform(column: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the value and ``seed``."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(2**53))


def mix_sources(docs: DataFrame, given: dict | None = None, share: float = SAMPLE_SHARE, seed: int = 17, max_cells: int = MAX_CELLS, rounds: int = ROUNDS, keep: tuple[str, ...] = (), topics_by: str = "form") -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, kept; and the columns ``keep`` of ``docs``."""
    if topics_by not in ("form", "words"):
        raise ValueError(f"topics_by is form or words, not {topics_by!r}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    columns = [
        doc_id.alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit(NULL)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NULL)).alias("lang"),
        F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(doc_id).alias("draw"),
        *keep,
    ]
    if "topic" in docs.columns or topics_by == "form":
        topic = F.coalesce(F.col("topic").cast("string"), F.lit(NULL)) if "topic" in docs.columns else form_topic(text)
        tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")
        labelled = stage(docs.select(*columns, tokens, topic.alias("topic")), "mix-rows")
    else:
        vectored = stage(with_vectors(docs.select(*columns, text.alias("text"))), "mix-rows")
        labelled = vectored.withColumn("topic", topic_of(fit_topics(vectored), F.col("vector"))).drop("vector")
    cells = stage(labelled.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    raked = rake_cells(cells, given, share, max_cells, rounds).select(*MARGINS, "probability")
    if cells.limit(max_cells + 1).count() <= max_cells:
        raked = F.broadcast(raked)  # at most max_cells rows, counted
    out = labelled.join(raked, list(MARGINS), "left")
    kept = uniform(F.col("draw"), seed) < F.col("probability")
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", kept.alias("kept"), *keep)


def margin_report(mixed: DataFrame, given: dict | None = None, share: float = SAMPLE_SHARE) -> DataFrame:
    """How well ``mixed`` (of ``mix_sources`` with the same targets) meets its marginals.

    One row per value of each margin, also of values that are asked for and absent: margin, value, tokens that there are, goal and expected tokens,
    residual (expected less goal, as a share of all tokens asked for).  A residual below zero where expected equals tokens is a value that has too few.
    """
    given, spark = given or {}, mixed.sparkSession
    cells = stage(mixed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")), "mix-margins")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    budget, parts = share * total, []
    for margin in MARGINS:
        sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("expected").alias("expected"))
        if margin in given:
            whole = float(sum(given[margin].values()))
            goals = spark.createDataFrame([(k, float(v) / whole * budget) for k, v in given[margin].items()], "value string, goal double")
            sums = sums.join(goals, "value", "full")
        else:
            power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / max(total, 1.0), F.lit(TEMPERATURES[margin]))).otherwise(0.0)
            norm = max(float(sums.agg(F.sum(power)).first()[0] or 0), 1e-300)
            sums = sums.withColumn("goal", power / norm * budget)
        zero = F.lit(0)
        columns = [F.coalesce("tokens", zero).cast("long").alias("tokens"), F.coalesce("goal", zero).cast("double").alias("goal"), F.coalesce("expected", zero).cast("double").alias("expected")]
        parts.append(sums.select(F.lit(margin).alias("margin"), "value", *columns))
    report = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return report.withColumn("residual", (F.col("expected") - F.col("goal")) / max(budget, 1e-300))
