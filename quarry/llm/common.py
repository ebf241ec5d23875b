"""What several operators share: written tables, text buffers, words of a batch."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SWEPT = [0.0]
SWEEP_SECONDS = 4

#: Bytes of text that numpy works on at once; temporaries are some ten times that.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where that is
    unset and all runs on this machine, as in tests, a folder of it."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def sweep(spark: SparkSession, every: float = 0) -> None:
    """Let the driver's JVM collect plans that are done: Spark deletes the shuffle files of such."""
    if time.monotonic() - _SWEPT[0] >= every:
        spark.sparkContext._jvm.System.gc()
        _SWEPT[0] = time.monotonic()


class Scratch:
    """Tables written as Parquet to the shared folder, to cut lineage: a lost executor
    then costs its own tasks only. They go when dropped or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        atexit.register(self._delete, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        sweep(self.spark, SWEEP_SECONDS)
        return self.load(name, df.schema)

    def save_bucketed(self, df: DataFrame, only: DataFrame, name: str, key: str) -> DataFrame:
        """Rows of df whose key is in `only` (distinct keys), written in as many buckets by key as a
        shuffle has partitions: joins on the key, however many, do not shuffle them again. At
        every size df is shuffled once, straight to its buckets."""
        buckets, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"quarry_{uuid.uuid4().hex}"
        some = df.repartition(buckets, key).join(only.select(key).repartition(buckets, key).hint("merge"), key)
        writer = some.write.format("parquet").bucketBy(buckets, key).sortBy(key)
        writer.option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        sweep(self.spark, SWEEP_SECONDS)
        return self.spark.table(table)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        if name in self.tables:
            self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
        self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; a cluster's own cleaning remains
            pass


def free_names(taken: list[str], *names: str) -> list[str]:
    """names, with underscores behind them as far as a column of `taken` has the name already."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def frugal(run):
    """run, a function of batches, that in the end gives free memory back to the system: Python
    workers stay for later tasks, and all that they hold counts as their executor's."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidy


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, most: int | None = None):
    """(first, last + 1) of runs of rows with about `limit` bytes, and at most `most` rows; one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, i + most) if most else j
        yield i, j
        i = j


def slices(data: np.ndarray, starts: np.ndarray, end: int) -> pa.Array:
    """Consecutive slices of a byte buffer as an Arrow binary array, without a copy."""
    offsets = np.append(starts, end).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser; consumes x."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def hash_values(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct byte strings."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
