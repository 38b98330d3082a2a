"""What the training-data operators share: tables, the shared folder, packing.

Rules that hold for all operators here:

* A null text is an empty text. A null id is an id of its own, below all others.
* Operators read only the columns they name, so extra columns never clash.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
  all executors see, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators.
NULL_ID = -(2**63)
#: What a batch between the JVM and Python holds, at most, beside its last row: each task has several on both sides.
BATCH_BYTES, _BATCH_SETTING, _UNSET = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", (None, "64MB", "64m", "67108864b", "67108864", "2147483647b", "2147483647")


def bounded(spark: SparkSession) -> None:
    """Bound the session's batches by bytes, unless it has a bound of its own: rows may be texts of any length."""
    if spark.conf.get(_BATCH_SETTING, None) in _UNSET:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A scan with fewer parts than there are cores (a small input in one file) is dealt out; a larger one is not shuffled."""
    bounded(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def key_of(column: str) -> Column:
    """An id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_of(column: str) -> Column:
    """The inverse of key_of."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def sum_of(text_column: str = "text") -> Column:
    """64 bits of a text: tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("sum")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: it cuts the lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of batches that leaves no freed memory behind, however it ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, about most bytes of the column's text at a time; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def chosen(chance: float, *columns: str, salt: int = 0) -> Column:
    """Whether a row is in a sample of this share, by 53 bits of its columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *columns), 11).cast("double") < min(1.0, chance) * 2.0**53


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not use in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, byte plane by byte plane."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, raw = data[0], np.frombuffer(data, np.uint8, offset=1)
    planes = np.zeros((len(raw) // width, 8), np.uint8)
    planes[:, :width] = raw.reshape(width, -1).T
    return planes.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """As pack, for ascending values: differences."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit integers: each input bit flips each output bit with a chance of a half."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
