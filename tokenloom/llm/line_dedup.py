"""Line deduplication by range-partitioned hashes.

1. Each text is split into lines; each distinct key of a text is hashed to 128
   bits and sent, with its positions, as (hash, document, positions).
2. The rows are dealt out by *range* over (hash, document) and sorted there, so a
   line that a third of all documents hold lies in as many tasks as its rows need.
3. Each task streams its sorted rows once. A run of one hash that lies whole in
   the task is decided there; of the two runs at the task's ends, only a summary
   (documents, first and last document) meets the neighbours' summaries: two rows
   a task, whatever the input.
4. Dropped positions become one compressed keep bitmap for each document. Texts
   are not shuffled until a caller applies the bitmaps.

Defined results: null text: one empty line. A null id is one document with the
smallest id. Rows that repeat an id and a text share one decision; rows with the
same id and other texts count as one document and are decided line by line.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh, key_of, materialise, sum_of, table, tidy
from .quality_rules import recount

MIN_CHARS = 40
MIN_DOCS = 5

STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(FOLD)


def _lines(min_chars: int):
    """(key, sum, text) rows to one row for each distinct long line of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, check, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        found.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")), []).append(i)
                for digest, where in found.items():
                    high, low = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                    for column, value in zip(rows, (high, low, doc.as_py(), check.as_py(), where), strict=True):
                        column.append(value)
                if len(rows[0]) > 20_000:
                    yield _line_rows(rows)
                    rows = [[], [], [], [], []]
            yield _line_rows(rows)

    return run


def _line_rows(rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in rows[:4]] + [pa.array(rows[4], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, LINE_COLUMNS)


LINE_COLUMNS = ["high", "low", "doc", "sum", "lines"]
LINE_SCHEMA = "high long, low long, doc long, sum long, lines array<int>"
#: kind 0: lines that go. 1: lines of a run that is open at an end of the task. 2: the summary of such a run, in docs, first and last.
DECIDED_COLUMNS = [*LINE_COLUMNS, "kind", "docs", "first", "last"]
DECIDED_SCHEMA = f"{LINE_SCHEMA}, kind int, docs long, first long, last long"


class _Run:
    """The run of one hash that a task is in."""

    def __init__(self, key: tuple[int, int], opened: bool):
        self.key, self.opened, self.docs, self.first, self.last, self.held = key, opened, 0, None, None, []

    def add(self, rows: pa.RecordBatch, min_docs: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        """Rows that are known to go (0) or are left open (1); up to min_docs documents are held until their number decides."""
        doc = rows.column(2).to_numpy()
        if self.first is None:
            self.first = doc[0]
        self.docs += int(np.count_nonzero(np.diff(doc))) + (self.last is None or doc[0] != self.last)
        self.last = doc[-1]
        if self.opened:
            yield rows, 1
        elif self.docs < min_docs:
            self.held.append(rows)
        else:
            for x in [*self.held, rows]:
                yield x.filter(pa.array(x.column(2).to_numpy() != self.first)), 0
            self.held = []


def _decide(min_docs: int):
    """Stream rows sorted by hash, then document descending: the first document of a run keeps its lines."""

    def told(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        n = rows.num_rows
        nothing = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, kind, np.int32)), nothing, nothing, nothing], DECIDED_COLUMNS)

    def summary(run: _Run) -> pa.RecordBatch:
        longs = [[x] for x in (*run.key, None, None)]
        rest = [pa.array([None], pa.list_(pa.int32())), pa.array([2], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (run.docs, run.first, run.last))]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), *rest], DECIDED_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, doc = (batch.column(i).to_numpy() for i in range(3))
            starts = np.concatenate(([0], np.flatnonzero((np.diff(high) != 0) | (np.diff(low) != 0)) + 1))
            stops = np.concatenate((starts[1:], [len(high)]))
            for k in sorted({0, len(starts) - 1}):
                if k:  # the runs between the first and the last lie whole in this batch
                    a, b = int(starts[1]), int(starts[-1])
                    if b > a:
                        runs = np.repeat(np.arange(len(starts) - 2), (stops - starts)[1:-1])
                        new = np.concatenate(([True], (np.diff(doc[a:b]) != 0) | (np.diff(runs) != 0)))
                        docs = np.add.reduceat(new.astype(np.int64), starts[1:-1] - a)
                        gone = (docs[runs] >= min_docs) & (doc[a:b] != doc[starts[1:-1]][runs])
                        yield told(batch.slice(a, b - a).filter(pa.array(gone)), 0)
                key = (int(high[starts[k]]), int(low[starts[k]]))
                if now is None or now.key != key:
                    if now is not None and now.opened:
                        yield summary(now)
                    now = _Run(key, opened=now is None)
                for rows, kind in now.add(batch.slice(int(starts[k]), int(stops[k] - starts[k])), min_docs):
                    yield told(rows, kind)
        if now is not None:
            for rows in now.held:
                yield told(rows, 1)
            yield summary(now)

    return run


def _join_summaries(rows: list, min_docs: int) -> list[tuple[int, int, int]]:
    """(high, low, newest document) of the open runs that min_docs documents hold."""
    runs: dict[tuple[int, int], list] = {}
    for r in rows:
        runs.setdefault((r.high, r.low), []).append((r.first, r.last, r.docs))
    out = []
    for key, parts in runs.items():
        parts.sort(key=lambda x: (-x[0], -x[1]))
        docs = sum(x[2] for x in parts) - sum(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        if docs >= min_docs:
            out.append((*key, parts[0][0]))
    return out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for lists in batch.column(2).to_pylist():
            gone = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]))
            keep = np.ones(int(gone[-1]) // 8 * 8 + 8, bool)  # whole bytes
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["key", "sum", "bitmap"])


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines, dropped lines and what stays of a text. Lines beyond the bitmap stay."""
    text = text or ""
    lines = text.split("\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)]
    kept = [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """key, sum, bitmap: the compressed keep bitmap of each text that loses lines. key and sum are those of keyed()."""
    spark = docs.sparkSession
    # Written first: dealing out by range looks at the rows twice, and texts are to be cut once.
    rows = materialise(docs.select(key_of(id_column).alias("doc"), sum_of(text_column), text_column).mapInArrow(tidy(_lines(min_chars)), LINE_SCHEMA), "line-hashes")
    order = [F.col("high"), F.col("low"), F.col("doc").desc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    decided = materialise(dealt.mapInArrow(_decide(min_docs), DECIDED_SCHEMA), "lines")
    ends = decided.where("kind = 2").select("high", "low", "docs", "first", "last").collect()  # two rows a task at most
    known = spark.createDataFrame(_join_summaries(ends, min_docs), "high long, low long, newest long")
    opened = decided.where("kind = 1").join(F.broadcast(known), ["high", "low"]).where("doc <> newest")
    gone = decided.where("kind = 0").select("doc", "sum", "lines").union(opened.select("doc", "sum", "lines"))
    return gone.groupBy(F.col("doc").alias("key"), "sum").agg(F.collect_list("lines").alias("lists")).mapInArrow(_bitmaps, "key long, sum long, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """docs and a column of their bitmaps, with that column's name. The bitmaps are hashed, so texts are not sorted."""
    key, check, name = (fresh(x, docs) for x in ("__key", "__sum", "__bitmap"))
    found = bitmaps.select(F.col("key").alias(key), F.col("sum").alias(check), F.col("bitmap").alias(name))
    return docs.withColumns({key: key_of(id_column), check: sum_of(text_column)}).join(found.hint("shuffle_hash"), [key, check], "left").drop(key, check), name


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, name = with_bitmaps(docs, line_bitmaps(docs))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_lines(t.as_py(), b.as_py()) for t, b in zip(batch.column(1), batch.column(2), strict=True)]
            hashes = [hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() for r in rows]
            longs = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(hashes, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.select("doc_id", "text", name).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its dropped lines."""
    bounded(spark)
    marked, name = with_bitmaps(docs, line_bitmaps(docs))
    names = docs.columns
    at, end = names.index("text"), len(names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if b.as_py() is None else kept_lines(t.as_py(), b.as_py())[2] for t, b in zip(batch.column(at), batch.column(end), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(end)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return recount(marked.select(*(F.col(f"`{c}`") for c in docs.columns), name).mapInArrow(apply, docs.schema))
