"""Files of one table whose records changed over time: every schema is found and kept apart.

Schemas come from the footers of all files, which tasks read in parallel, a file once; the driver sees a row per distinct
footer.  Each schema's files are then one scan, so a record is read by the fields of its own file,
instead of a merged schema in which an absent field looks like a null one.

Defined cases: files of schemas that are equal but for nullability are one variant; a file without rows counts by its schema; a
folder without files is an error of Spark's reader, as ever.  More variants than ``most`` raise: each is a branch of the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas that files of one table may have.
MOST = 200
#: Footers that a task reads, at least.
FOOTERS = 64


@dataclass(frozen=True)
class FileVariant:
    """A schema and the files that have it, in order."""

    schema: T.StructType
    files: tuple[str, ...]


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, digest of the schema in its footer)."""
    import pyarrow.fs
    import pyarrow.parquet

    for batch in batches:
        digests = []
        for name in batch.column(0).to_pylist():
            files, path = pyarrow.fs.FileSystem.from_uri(name)
            schema = pyarrow.parquet.read_schema(path, filesystem=files)
            text = schema.to_string(show_field_metadata=False, show_schema_metadata=False)
            digests.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests)], ["file", "digest"])


def _opens(name: str) -> bool:
    """Whether pyarrow has a file system for a file's scheme."""
    import pyarrow.fs

    try:
        pyarrow.fs.FileSystem.from_uri(name)
    except pa.ArrowInvalid:
        return False
    return True


def file_variants(spark: SparkSession, path: str, kind: str = "parquet", most: int = MOST) -> list[FileVariant]:
    """The schemas of the files below ``path``, by their first files.

    Footers of Parquet files are read by tasks where pyarrow knows the file system; otherwise, and for other formats, Spark's reader
    is asked for each file's schema, one after another.
    """
    files = sorted(spark.read.format(kind).load(path).inputFiles())
    if kind == "parquet" and files and _opens(files[0]):
        tasks = min(-(-len(files) // FOOTERS), 4 * spark.sparkContext.defaultParallelism)
        named = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
        read = named.mapInArrow(_footers, "file string, digest string")
        groups = [r["files"] for r in read.groupBy("digest").agg(F.sort_array(F.collect_list("file")).alias("files")).limit(most + 1).collect()]
    else:
        groups = [[f] for f in files]
    found: dict[str, tuple[T.StructType, list[str]]] = {}
    for group in groups:
        schema = spark.read.format(kind).load(group[0]).schema
        found.setdefault(schema.json(), (schema, []))[1].extend(group)
        if len(found) > most:
            raise ValueError(f"more than {most} schemas below {path}")
    return sorted((FileVariant(schema, tuple(sorted(names))) for schema, names in found.values()), key=lambda v: v.files[0])


def read_variants(spark: SparkSession, path: str, kind: str = "parquet", most: int = MOST) -> list[DataFrame]:
    """One DataFrame for each schema of the files below ``path``; columns of partition folders come along."""
    variants = file_variants(spark, path, kind, most)
    return [spark.read.format(kind).option("basePath", path).schema(v.schema).load(list(v.files)) for v in variants]
