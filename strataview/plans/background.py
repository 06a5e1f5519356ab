"""Asynchronous profiling with interim specs, progress and a soft stop.

With ``parts`` above 1 the records are dealt into so many parts, which are profiled one after another and merged; after every
part the spec so far is saved.  Records of enough files are dealt by file, so that all parts together read the source once; others
are dealt by a hash of the row, with a scan of the source for each part.  A stop cancels the part at hand and keeps the last spec,
which is valid for the records that it counts.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataview.plans.options import make_options
from strataview.plans.profile import fixed_rows, profile
from strataview.plans.spec import RawSpec


#: Files of a part at least, for parts of even size, if records are to be dealt by file.
FILES = 4


def hashable(dtype: T.DataType) -> bool:
    """Whether values of a type have a hash: no map or variant at any depth."""
    if isinstance(dtype, T.StructType):
        return all(hashable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return hashable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def deal(df: DataFrame, parts: int, by_file: bool = True) -> list[DataFrame]:
    """The records of ``df`` in so many parts that have no record in common.

    By file where the rows come, not cached, from one scan of at least ``FILES`` files a part: Spark leaves out the other parts' files
    before it reads.  Otherwise by a hash of the row; maps and variants, and what holds them, have none, so their text is taken.
    """
    deal_by = None
    if by_file and not df.is_cached and len(df.inputFiles()) >= FILES * parts:
        name = F.col("_metadata.file_path")
        try:
            df.where(name.isNotNull()).schema  # noqa: B018  resolves the plan
            deal_by = F.xxhash64(name)
        except AnalysisException:
            pass  # rows of several sources, or of none
    if deal_by is None:
        deal_by = F.xxhash64(*(F.col(f"`{f.name}`") if hashable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields))
    return [df.where(F.pmod(deal_by, F.lit(parts)) == k) for k in range(parts)]


class Probe:
    """A profile that runs in a thread of its own and saves its spec to ``output_path``.

    ``progress`` holds (parts done, parts, seconds); ``where_saved`` is the folder of the last spec.
    """

    def __init__(self, df: DataFrame, probe=0, *, output_path: str, parts: int = 1, **options):
        self.group = f"probe-{uuid.uuid4().hex}"
        self.output_path, self.error = output_path, None
        self.progress: list[tuple[int, int, float]] = []
        self.where_saved: str | None = None
        self._spark, self._stopped = df.sparkSession, threading.Event()

        def run() -> None:
            self._spark.sparkContext.setJobGroup(self.group, "profile", interruptOnCancel=True)
            try:
                self._run(df, probe, parts, options)
            except Exception as error:  # noqa: BLE001  kept for the caller
                self.error = None if self._stopped.is_set() and self.where_saved else error

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def _run(self, df: DataFrame, probe, parts: int, options: dict) -> None:
        began = time.monotonic()
        if parts <= 1:
            profile(df, probe, output_path=self.output_path, **options)
            self.where_saved = self.output_path
            self.progress.append((1, 1, time.monotonic() - began))
            return
        limit = make_options(**options).limit
        if limit is not None:
            # these rows are fixed; their files may hold others
            df, options = fixed_rows(df.limit(limit)), {**options, "limit": None}
        dealt = deal(df, parts, by_file=limit is None)
        spec: RawSpec | None = None
        processed = 0
        for k in range(parts):
            if self._stopped.is_set():
                return
            path = self.output_path if k == parts - 1 else f"{self.output_path}-interim-{k + 1}"
            part = f"{self.output_path}-part"
            one = profile(dealt[k], probe, output_path=part, **options)
            processed += one.meta["processed"]
            one = RawSpec.load(self._spark, part)
            spec = (one if spec is None else spec.merge(one)).with_meta(processed=processed)
            spec.save(path, "overwrite")
            spec, self.where_saved = RawSpec.load(self._spark, path), path
            self.progress.append((k + 1, parts, time.monotonic() - began))

    def running(self) -> bool:
        return self._thread.is_alive()

    def stop(self) -> None:
        """Cancel what runs; the spec of the parts that are done stays."""
        self._stopped.set()
        self._spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, timeout: float | None = None) -> RawSpec | None:
        """The final spec, or after a stop the last interim one (None if no part was done)."""
        self._thread.join(timeout)
        if self.error and not self._stopped.is_set():
            raise self.error
        return RawSpec.load(self._spark, self.where_saved) if self.where_saved else None
