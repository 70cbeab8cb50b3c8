"""Shared helpers: the shared working folder, written tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none set gets a temporary folder; a cluster without the setting
    is an error, since a folder of one machine would not be visible to the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="skyloom-")
    return _local_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"


#: Documents of a task that writes what belongs to documents.
TASK_DOCS = 4096


def in_few(df: DataFrame, documents: int) -> DataFrame:
    """``df``, some rows for each of so many documents, in a task for each TASK_DOCS of them where it is in more. Few documents
    in many partitions would be as many files of a few rows, and for each of them Hadoop's local file system starts several
    processes, which for a moment take as much memory as the executor itself."""
    return df.coalesce(max(1, -(-documents // TASK_DOCS)))


def stored(df: DataFrame, name: str, documents: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps do not depend on
    executors that may be lost, nor compute it anew. ``documents``: see ``in_few``."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if documents is None else in_few(df, documents)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(rows: DataFrame, size: int, *key: Column, by: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """About ``size`` rows (of each value of ``by``): those whose hash of ``key`` lies in the first part of all hashes that is
    expected to hold so many. Nothing is ordered and no key is gathered; all rows if they are no more. Rows of one hash count
    once, so that a row that is there many times doesn't fill the sample. ``sizes``: rows by value, if they are known."""
    hashed = rows.withColumn("_h", F.xxhash64(*key))
    place = F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))
    if by is None:
        n = rows.count()
        return hashed.where(place < size / max(1, n)).dropDuplicates(["_h"]).drop("_h")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    return hashed.join(counts, by).where(place < F.lit(float(size)) / F.col("_n")).dropDuplicates([by, "_h"]).drop("_h", "_n")


#: Rows of a table up to which it is sent to all tasks; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, which is stored, with a hint to broadcast it if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def written_files(blobs: DataFrame, name: str, separator: str) -> str:
    """Writes each row of the one binary column as a file of its own and returns the folder.

    Spark's text writer puts out the bytes of a string unchanged and closes each with its line
    separator; with one record a file, any file system that Spark can write to gets the files, by
    the commit protocol that makes repeated and lost tasks harmless. ``separator`` must be bytes
    that readers of the format skip.
    """
    path = scratch(blobs.sparkSession, name)
    column = blobs.columns[0]
    (blobs.select(blobs[column].cast("string").alias("value"))
     .write.option("lineSep", separator).option("maxRecordsPerFile", 1).option("compression", "none").text(path))
    return path


#: Bytes of an Arrow batch on its way to Python, unless the session sets its own bound.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Batches by size, as texts may be of any length: a bound on rows alone lets a batch of long ones fill the memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of ``batches`` as tuples of the named columns."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, 256):  # a slice at a time: long texts are Python objects only briefly
            yield from zip(*(c.slice(at, 256).to_pylist() for c in columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)
        buffer = []
    give_back()


#: What frees the tables that operators keep in this worker, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, free: Callable[[], None]) -> None:
    """This worker's tables are now the operator's: those that other operators' tasks left behind are freed."""
    others = [name for name in _kept if name != operator]
    for name in others:
        _kept.pop(name)()
    if others:
        give_back()
    _kept[operator] = free


def give_back() -> None:
    """Unused memory of this worker goes back to the system: other stages' tasks use the same worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere the allocator is left alone
    if trim is not None:
        trim(0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
