"""What the operators of this subpackage share: table reads, the shared scratch folder, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes, at most, of the part of an Arrow batch that an operator turns into Python objects at once
#: (a single longer row is a part of its own). Spark itself closes a batch at 64 MB.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Held while an intermediate table is written: Spark deletes the query's shuffle files when it ends, and closes Arrow batches early.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(2 * BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, only where that is unset,
    the context's checkpoint folder or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


class Scratch:
    """The intermediate tables of one computation, in the shared folder.

    put() cuts the lineage: a lost executor then costs a read of the table, not a recomputation, and what isn't
    deterministic (row ids) is fixed. drop() deletes tables that nothing will read again; end() stores the result and
    deletes all others. What is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{scratch_root(self.spark)}/{self.name}-{name}-{uuid.uuid4().hex}"
        _written.append((self.spark, path))
        write(df, path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            for entry in [t for t in self.tables if t[0] is frame]:
                self.tables.remove(entry)
                _written.remove((self.spark, entry[1]))
                _delete(self.spark, entry[1])

    def end(self, df: DataFrame, name: str = "result") -> DataFrame:
        result = self.put(df, name)
        self.drop(*[t for t, _ in self.tables if t is not result])
        return result


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; its shuffle files go as soon as it is written. The session's settings are as before afterwards."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder."""
    return Scratch(df.sparkSession, "table").put(df, name)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
                return


def map_batches(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches small enough for a worker even when every row is a very long document."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))
            yield from (batch.slice(at, n) for at in range(0, batch.num_rows, n))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(parts(batches))
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return memory that a task has freed to the system. Spark reuses workers, and an idle one would keep it beside the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
