"""Specs: the mergeable result of a profile, as a handful of small tables.

``RawSpec`` is what profiling and merging give; ``View`` is the post-processed form for
reading.  They are different classes because post-processing may not be applied twice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from strataview.operators import merge as M
from strataview.operators import postproc as P
from strataview.operators.sketches import merge_registers

TABLES = ("nodes", "registers", "samples", "extremes", "dictionary", "histogram")


def united_meta(metas: list[dict]) -> dict:
    """Metadata of the first with the fields and record variants of all, each once, in order of appearance."""

    def every(name: str) -> list:
        return list({json.dumps(x): x for meta in metas for x in meta.get(name) or ()}.values())

    return {**metas[0], "fields": every("fields"), "records": every("records"), "truncated": every("truncated")}


@dataclass(frozen=True)
class Spec:
    """Tables: nodes (path, class, n); registers (idx, rank); samples and dictionary (vtext, n, span);
    extremes (which, value, n, span); histogram (bucket, n); and the run's metadata."""

    nodes: DataFrame
    registers: DataFrame | None
    samples: DataFrame | None
    extremes: DataFrame
    dictionary: DataFrame
    histogram: DataFrame
    meta: dict

    def tables(self) -> dict[str, DataFrame]:
        return {t: df for t in TABLES if (df := getattr(self, t)) is not None}

    def persist(self):
        """Keep the tables in memory for repeated reading."""
        return replace(self, **{name: df.persist(StorageLevel.MEMORY_AND_DISK) for name, df in self.tables().items()})

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the tables and the metadata below ``path``."""
        spark = self.nodes.sparkSession
        for name, df in self.tables().items():
            df.write.mode(mode).parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps(self.meta, default=str),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def _load(cls, spark: SparkSession, path: str):
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    absent = {t for t, on in (("registers", meta.get("hll_b")), ("samples", meta.get("samples"))) if not on}
    return cls(**{t: None if t in absent else spark.read.parquet(f"{path}/{t}") for t in TABLES}, meta=meta)


@dataclass(frozen=True)
class RawSpec(Spec):
    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RawSpec:
        return _load(cls, spark, path)

    def merge(self, *others: RawSpec) -> RawSpec:
        """The spec of all records together.  Specs must agree on sketch width, sampler size and hash."""
        for name in ("hll_b", "samples", "hash"):
            if len({str(s.meta.get(name)) for s in (self, *others)}) > 1:
                raise ValueError(f"specs with different {name!r} cannot be merged")
        every = (self, *others)

        def union(table: str) -> DataFrame:
            return reduce(DataFrame.unionByName, (getattr(s, table) for s in every))

        k = None if self.meta["samples"] in ("all", None) else int(self.meta["samples"])
        meta = {**united_meta([s.meta for s in every]), "processed": sum(s.meta.get("processed") or 0 for s in every), "started": min(str(s.meta.get("started")) for s in every), "ended": max(str(s.meta.get("ended")) for s in every)}
        return RawSpec(
            nodes=M.merge_nodes(union("nodes")),
            registers=merge_registers(union("registers")) if self.registers is not None else None,
            samples=M.merge_sample_table(union("samples"), k) if self.samples is not None else None,
            extremes=M.merge_extremes(union("extremes")),
            dictionary=M.merge_dictionary(union("dictionary")),
            histogram=M.merge_histogram(union("histogram")),
            meta=meta,
        )

    def postproc(self) -> View:
        """Drop empty abstract types, then let statistics propagate to supertypes."""
        kept = P.compact(self.nodes)
        k = None if self.meta["samples"] in ("all", None) else int(self.meta["samples"])
        return View(
            nodes=P.join_up_nodes(self.nodes, kept),
            registers=merge_registers(P.lift(self.registers, kept)) if self.registers is not None else None,
            samples=M.merge_sample_table(P.lift(self.samples, kept), k) if self.samples is not None else None,
            extremes=M.merge_extremes(P.lift(self.extremes, kept)),
            dictionary=M.merge_dictionary(P.lift_ext(self.dictionary, kept)),
            histogram=M.merge_histogram(P.lift_ext(self.histogram, kept)),
            meta=self.meta,
        )

    def with_meta(self, **values) -> RawSpec:
        return replace(self, meta={**self.meta, **values})


@dataclass(frozen=True)
class View(Spec):
    """A post-processed spec."""

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> View:
        return _load(cls, spark, path)

    def sorted_nodes(self) -> DataFrame:
        return P.sorted_alternatives(self.nodes)
