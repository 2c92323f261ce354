"""Shared helpers: tables in the folder that all executors see, and bounded slices of Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"

#: A key with more rows than this, and than a share of MOST_HOT of all, is joined in parts; so at most MOST_HOT such keys are broadcast.
HOT, MOST_HOT = 4096, 4096
#: Longer words are not kept in the workers' caches, so that those have a bound in bytes.
LONG_WORD = 64

#: On a local shared folder Hadoop starts a process for each file, checksum file and folder it makes. So intermediate tables have neither checksum
#: files nor a success mark; the checksums of Parquet's pages are read instead.
_PLAIN = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "parquet.page.write-checksum.enabled": "true",
}
_VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}

_own_folder: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder from ``spark.checkpoint.dir``; a folder of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="shelfmark-"))
        spark.sparkContext.setCheckpointDir(_own_folder[0])
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).options(**_VERIFIED).parquet(path)


def spread(rows: DataFrame, known: DataFrame, key: str, counts: DataFrame, salt: Column) -> DataFrame:
    """``rows`` joined with ``known`` by ``key``; ``counts``: key and n, its rows. A key with a large share of all rows is joined in parts, by ``salt`` of the row."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    share = max(HOT, (total or 0) // MOST_HOT)
    if (most or 0) <= share:
        return rows.join(known, key)
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.withColumn("_salt", salt).join(hot, key, "left").withColumn("_salt", F.pmod("_salt", parts).cast("int")).drop("_parts")
    copies = known.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


@atexit.register
def _remove_written() -> None:
    """Remove the intermediate tables when the driver ends."""
    for spark, path in _written:
        try:
            jvm, context = spark._jvm, spark.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may have ended before
            return


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow; at its end the worker, which Spark keeps for later tasks, holds no more than it needs."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes each (one row may exceed it): bounds numpy's scratch space."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not len(values):
            continue
        _, data = text_buffer(values)
        if len(data) <= most:
            yield batch
            continue
        ends = text_buffer(values)[0]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, ends[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def text_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, one more than rows) and the UTF-8 bytes of a string or binary array without copying; nulls are empty."""
    if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = values.buffers()
    if offsets is None:
        return np.zeros(len(values) + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, kind, len(values) + 1, values.offset * kind().itemsize).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], bytes_[ends[0] : ends[-1]]
