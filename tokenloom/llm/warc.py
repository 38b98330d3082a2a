"""WARC archives as a chunked record table.

Writing: each task streams its rows into archive files of its own (a new file
once one is full), payloads in slices. A file is written under a temporary name
and renamed once complete, so a task that is lost or run twice leaves nothing
half done; only files that the committed index names are read.

Reading: each file is streamed in fixed blocks. A payload becomes rows of
(record, chunk number, bytes) with the SHA-256 carried along from chunk to chunk;
no record is ever held whole. The last chunk of a record tells its size and digest.

Defined results: a null html is an empty payload. Rows that repeat both page_id
and payload are one record's copies and get the same type. Null ids are below all
others and come back null. An empty table gives an empty archive and table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, key_of, materialise, new_path, table, tidy

MIN_REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
CHUNK_BYTES = 1 << 20
#: Reading tasks, at most; beyond that a task reads several files.
MOST_READERS = 100_000

INDEX_SCHEMA = "path string, records long, bytes long"
CHUNK_SCHEMA = "path string, record_id string, chunk_no long, data binary, warc_type string, target_uri string, refers_to string, stated_digest string, stated_bytes long, bytes_so_far long, digest string, is_last boolean"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI: local and shared folders, HDFS, object stores."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class _Archives:
    """The archive files of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(_uri(folder))
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.size, self.records, self.done = None, 0, 0, []

    def write(self, head: bytes, payload: memoryview) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc"
            self.out, self.size, self.records = self.fs.open_output_stream(self.name + ".tmp"), 0, 0
        self.out.write(head)
        for at in range(0, len(payload), CHUNK_BYTES):
            self.out.write(payload[at : at + CHUNK_BYTES])
        self.out.write(b"\r\n\r\n")
        self.size += len(head) + len(payload) + 4
        self.records += 1
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.name + ".tmp", self.name)
            self.done.append((self.name, self.records, self.size))
            self.out = None


def record_head(record_id: str, kind: str, uri: str, digest: str, size: int, refers_to: str | None, body: int) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {body}", "", ""]).encode()


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write a record for each row and return the index of the files. Payloads seen before, by digest, become revisits.

    Only (id, digest, size) meets across tasks: the smallest id of a digest is found
    by an aggregate with partial sums and joined back, which Spark can split where
    one payload has a third of all rows.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    rows = pages.select(key_of(id_column).alias("key"), F.col(url_column).alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha2("body", 256), "size": F.octet_length("body").cast("long")})
    first = rows.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select("digest", "first"), "warc-first")
    rows = rows.join(first, "digest", "left")  # only digests that occur twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = _Archives(folder)
        for batch in batches:
            for key, url, body, digest, size, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                key, first, size = key.as_py(), first.as_py(), size.as_py()
                again = first is not None and first != key
                payload = memoryview(b"") if again else memoryview(body.as_buffer())
                name = "null" if key == NULL_ID else str(key)
                refers = None if not again else "null" if first == NULL_ID else str(first)
                to.write(record_head(name, "revisit" if again else "response", url.as_py() or "", digest.as_py(), size, refers, len(payload)), payload)
        to.close()
        for path, records, size in to.done:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    scheme = folder.split("://")[0] if "://" in folder else "file" if folder.startswith("file:") else ""
    index = rows.select("key", "url", "body", "digest", "size", "first").mapInArrow(run, INDEX_SCHEMA)
    index.withColumn("path", F.concat(F.lit(f"{scheme}://" if scheme not in ("", "file") else ""), "path")).write.parquet(f"{folder.rstrip('/')}-index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder.rstrip('/')}-index")


class _Reader:
    """Lines and counted bytes from a stream that is read in blocks."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            more = self.stream.read(1 << 16)
            if not more:
                return None
            self.held += more
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def some(self, n: int) -> bytes:
        """n bytes, less only at the end."""
        if len(self.held) < n:
            self.held += self.stream.read(max(n - len(self.held), 1 << 16))
        out, self.held = self.held[:n], self.held[n:]
        return out


def read_records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """(headers, chunk number, bytes, size so far, digest so far or None before the last chunk, whether it is the last)."""
    source = _Reader(stream)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        left, digest, size, number = int(headers["content-length"]), hashlib.sha256(), 0, 0
        while True:
            data = source.some(min(left, chunk_bytes)) if left else b""
            if left and not data:
                raise ValueError("a record ends early")
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield headers, number, data, size, digest.copy().hexdigest() if not left else None, not left
            number += 1
            if not left:
                break


def read_warc(index: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the files in index: a row for each chunk of each record."""
    names = [x.strip().split(" ")[0] for x in CHUNK_SCHEMA.split(",")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def bare(urn: str | None) -> str | None:
        return urn.removeprefix("<urn:page:").removesuffix(">") if urn else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = file_system(_uri(path))
                held, rows = 0, []
                with fs.open_input_stream(inner) as stream:
                    for h, number, data, size, digest, last in read_records(stream, chunk_bytes):
                        stated = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        rows.append((path, bare(h["warc-record-id"]), number, data if with_data else None, h["warc-type"], unquote(h.get("warc-target-uri", "")), bare(h.get("warc-refers-to")), stated, int(h.get("x-payload-length", size)), size, digest, last))
                        held += len(data) * with_data + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            held, rows = 0, []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = index.select("path")
    # A task for each file: by its size alone the index would be one partition.
    return files.repartition(max(1, min(files.count(), MOST_READERS))).mapInArrow(tidy(run), CHUNK_SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response's size and digest are those of the bytes that were read; a revisit's are its headers', which name the full payload."""
    index = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    last = read_warc(index, with_data=False).where("is_last")
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    revisit = F.col("warc_type") == "revisit"
    return last.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


__all__ = ["op3", "read_records", "read_warc", "record_head", "write_warc"]
