"""A spec of terms that the caller adds one by one.

Terms wait on the driver; once ``at_once`` terms or ``CHARS`` characters are held, they are written to the shared folder.  When a spec is asked
for, or ``FOLD`` such parts are there, one job over all parts fills node states, which are written too.  So the driver holds a bounded part, and
the spec is the merge of the states.
Terms are Python values: numbers, booleans, None, texts, lists and tuples, and dicts with text keys, nested to any depth.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataview.plans.options import make_options
from strataview.plans.profile import meta_of, spec_of, states_of
from strataview.plans.spec import RawSpec
from strataview.sources.tables import shared_folder

CHARS = 16 << 20
#: Parts whose node states are filled by one job.
FOLD = 500


def text_of(term: Any) -> str:
    """The term as JSON; a float has an exponent, by which variants tell 1.0 from 1."""
    if isinstance(term, float):
        if term != term or term in (float("inf"), float("-inf")):
            raise ValueError(f"{term} has no place in a term")
        return repr(term) if "e" in repr(term) else f"{term!r}e0"
    if isinstance(term, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{text_of(v)}" for k, v in term.items()) + "}"
    if isinstance(term, (list, tuple)):
        return "[" + ",".join(map(text_of, term)) + "]"
    return json.dumps(term, ensure_ascii=False)


class TermSpec:
    """``add`` terms, then ask for the ``spec``; ``attributes`` are the types of ``ts`` and ``key``."""

    def __init__(self, spark: SparkSession, attributes: str = "ts timestamp, key string", at_once: int = 10_000, **options):
        self.spark, self.at_once, self.schema = spark, at_once, f"term string, {attributes}"
        self.options = make_options(**{"limit": None, **options})
        self.path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
        self._held: list[tuple] = []
        self._parts: list[str] = []
        self._chars = self._spills = self.processed = 0
        self._meta: dict | None = None

    def add(self, term: Any, ts: Any = None, key: Any = None) -> None:
        text = text_of(term)
        self._held.append((text, ts, key))
        self._chars += len(text)
        self.processed += 1
        if len(self._held) >= self.at_once or self._chars >= CHARS:
            self.spill()

    def spill(self) -> None:
        """Write what is held."""
        if not self._held and self._spills:
            return
        rows = self.spark.createDataFrame(self._held, self.schema)
        self._parts.append(f"{self.path}/terms-{self._spills}")
        rows.coalesce(1).write.mode("overwrite").parquet(self._parts[-1])
        self._held, self._chars, self._spills = [], 0, self._spills + 1
        if len(self._parts) >= FOLD:
            self.fold()

    def fold(self) -> None:
        """Turn the parts into node states."""
        if not self._parts:
            return
        rows = self.spark.read.schema(self.schema).parquet(*self._parts).withColumn("term", F.parse_json("term"))
        probe = ("term", {"ts": "ts", "key": "key"})
        self._meta = self._meta or meta_of(rows, probe, self.options)
        states_of(rows, probe, self.options).write.mode("append").parquet(f"{self.path}/states")
        self._parts = []

    def spec(self) -> RawSpec:
        """The spec of all terms added so far; more may be added after it."""
        self.spill()
        self.fold()
        return spec_of(self.spark.read.parquet(f"{self.path}/states"), self.options, {**self._meta, "processed": self.processed})
