"""WARC archives with an index written first and coalesced range reads.

``write_archives`` appends one gzip member per record and emits an index row
(file, offset, length, url, digest, type) for it.  The index is staged before any
read, so file names of the attempts that won are fixed.  ``read_records`` takes
any selection of index rows, sorts them by file and offset, merges neighbouring
ranges into few reads and parses the records from those.

Defined cases: a null payload is an empty one; a null id is always a response; rows
that repeat both id and payload are all responses if their id is the group's smallest;
control characters and blanks in a URL are percent-encoded, a null URL is
``about:blank``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.llm.staging import new_path, stage

#: An archive file is closed once it has this many bytes.
FILE_BYTES = 64 << 20
#: Ranges nearer than this are read together, up to READ_BYTES at once.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    if not url:
        return "about:blank"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> dict:
    """Fields of a record; the payload digest of a response is computed anew."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    stored = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != stored):
        raise ValueError(f"damaged record of {fields['WARC-Target-URI']}")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None,
        "payload_bytes": size,
        "payload_digest": stored,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, payload, digest, refers_to as archives; returns their index (lazy)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out = file = None
        for batch in batches:
            index = []
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers = (batch.column(k)[row].as_py() for k in range(5))
                if out is None:
                    file = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(file, compression=None)
                member = make_record(page_id, url, (payload or "").encode(), digest, refers)
                at = out.tell()
                out.write(member)
                index.append((file, at, len(member), _clean(url), digest, "response" if refers is None else "revisit", page_id))
                if at + len(member) >= FILE_BYTES:
                    out.close()
                    out = None
            if index:
                names = ["file", "offset", "length", "url", "digest", "record_type", "page_id"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX)


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Merge (offset, length), sorted by offset, into reads (begin, end, members)."""
    reads: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            begin, end, members = reads[-1]
            reads[-1] = (begin, max(end, offset + length), [*members, k])
        else:
            reads.append((offset, offset + length, [k]))
    return reads


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` selects."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.setdefault(file, []).append((offset, length))
            found = []
            for file, ranges in rows.items():
                with fs.open_input_file(file) as source:
                    for begin, end, members in coalesce_ranges(ranges):
                        data = source.read_at(end - begin, begin)
                        for k in members:
                            offset, length = ranges[k]
                            record = parse_record(data[offset - begin : offset - begin + length])
                            found.append([record[n] for n in names])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    # a number of its own: a row of the index is small, but stands for a read of its record
    files = index.select("file").distinct().count()
    ordered = index.select("file", "offset", "length").repartition(max(files, 1), "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, RECORD)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [payload_digest((p or "").encode()) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["page_id", "digest"])


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Write all pages, duplicates as revisit records; returns the staged index and the folder."""
    spark = pages.sparkSession
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"))
    digests = stage(source.select("page_id", "payload").mapInArrow(_digests, "page_id long, digest string"), "payload-digests")
    # partial aggregation first: a digest shared by a third of the pages is one row per task
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    later = digests.join(first, "digest").where("page_id > first_id").select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "first_id").distinct()
    with_digest = source.mapInArrow(_with_digest, "page_id long, url string, payload string, digest string")
    records = with_digest.join(later, (F.col("page_id") == F.col("later_id")) & (F.col("digest") == F.col("later_digest")), "left")
    folder = new_path(spark, "warc")
    index = stage(write_archives(records.withColumn("refers_to", F.col("first_id")), folder), "warc-index")
    return index, folder


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [payload_digest((p or "").encode()) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["page_id", "url", "payload", "digest"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives and read all records back."""
    index, folder = archive_pages(pages)
    return read_records(index, folder)
