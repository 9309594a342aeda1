"""Shared plumbing: tables, the shared scratch folder and Arrow batches."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no ``spark.checkpoint.dir``.
FALLBACK_DIR = "file:///tmp/barloom-checkpoints"
#: Texts are taken in parts of about so many bytes (a longer text is a part of its own).
PART_BYTES = 1 << 19
#: Arrow batches hold about so many bytes, whatever the length of the texts (unless the session says otherwise).
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores added as it takes to clash with no column."""
    low, out = {t.lower() for t in taken}, []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


#: Shuffle files go when their query ends; else they stay until the driver happens to collect its garbage.
_FREE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Shuffle files of each query that runs meanwhile go when it ends.  Only for results that are written or collected once."""
    return settings(spark, **{_FREE_CONF: "true"})


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them.  They go when the driver ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/barloom-{what}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        """Free a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of bounded size; the worker gives its memory back when a task ends."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_parts(column: pa.Array, size: int = PART_BYTES):
    """``(first row, bytes, start of each row, length of each row)`` of bounded parts of a string column."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo], np.diff(offsets[lo : hi + 1])
        lo = hi


def release() -> None:
    """Give freed memory back to the system at the end of a task; the worker may idle for long."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
