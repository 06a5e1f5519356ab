"""Specs of streams: every micro-batch adds its node states, which are merged when the spec is read.

A batch costs what it holds: its states are written below its own number, and nothing that was stored before is read.  A batch that is replayed
after a failure overwrites its own states, so it counts once.  Every ``fold_every`` batches the states since the last
folding are merged into a stored spec, so that reading stays cheap.  Merging is commutative, so late data needs no watermark.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataview.plans.options import make_options
from strataview.plans.profile import meta_of, spec_of, states_of
from strataview.plans.spec import RawSpec


class IncrementalSpec:
    """A spec below ``path`` that grows by batches."""

    def __init__(self, spark: SparkSession, path: str, probe=0, fold_every: int = 50, **options):
        self.spark, self.path, self.probe, self.fold_every = spark, path, probe, fold_every
        self.options = make_options(**{"limit": None, **options})

    def _stored(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def folded(self) -> int:
        """Last batch of the stored spec, -1 if there is none."""
        versions = self._stored("versions")
        return -1 if versions is None else versions.agg({"batch": "max"}).first()[0]

    def version(self) -> int:
        """Last batch that was added, -1 if none."""
        batches = self._stored("batches")
        last = None if batches is None else batches.agg({"batch": "max"}).first()[0]
        return max(self.folded(), -1 if last is None else last)

    def meta(self) -> dict | None:
        stored = self._stored("meta")
        return None if stored is None else json.loads(stored.first()["meta"])

    def current(self) -> RawSpec | None:
        """The spec of all batches so far."""
        folded, meta = self.folded(), self.meta()
        batches = self._stored("batches")
        new = None if batches is None else spec_of(batches.where(F.col("batch") > folded).drop("batch"), self.options, meta)
        if folded < 0:
            return new
        base = RawSpec.load(self.spark, f"{self.path}/v{folded}")
        return base if new is None else base.merge(new)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Add the states of a batch; one that was folded before is skipped, another one that was added before is replaced."""
        folded = self.folded()
        if batch_id <= folded:
            return
        meta = self.meta()
        if meta is None:
            meta = meta_of(batch, self.probe, self.options)
            self.spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.parquet(f"{self.path}/meta")
        for name in ("hll_b", "samples", "hash", "name"):
            if meta[name] != getattr(self.options, name):
                raise ValueError(f"the stored spec has another {name!r}")
        states_of(batch, self.probe, self.options).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
        if batch_id - folded >= self.fold_every:
            self.fold(batch_id)

    def fold(self, upto: int | None = None) -> None:
        """Merge what was added since the last folding into a stored spec."""
        upto = self.version() if upto is None else upto
        if upto > self.folded():
            self.current().save(f"{self.path}/v{upto}", "overwrite")
            self.spark.createDataFrame([(upto,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a stream; ``stop()`` of the returned query leaves a valid spec."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
