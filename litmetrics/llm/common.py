"""Helpers shared by the operators of this subpackage: stable row keys, written intermediates, vectorised hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


_LEFT: dict[str, SparkSession] = {}  # what materialise() wrote and nobody has discarded yet


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a single machine (a local master) takes a temporary folder of its own, which goes with the
    process; on a cluster that is an error, as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="litmetrics-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str, together: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and lost executors cost nothing.

    Readers and writers hold a row group at a time. together: how many rows are in one at most, where rows are of megabytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": together} if together else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    until_exit(spark, path)
    return out


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the process ends: lazy results may read it until then."""
    _LEFT[path] = spark


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing lazy reads it any more."""
    spark, path = df.sparkSession, df._written_to
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    _LEFT.pop(path, None)


@atexit.register
def _discard_left() -> None:
    """What lazy results still had to read goes when the process ends."""
    for path, spark in list(_LEFT.items()):
        try:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception:  # the JVM is gone: the folder is the cluster's to clean
            return


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, after which the worker gives the memory it no longer uses back: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return run


def with_uid(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Selects columns plus `_uid`, a non-null long that is unique per row.

    The key itself serves where it is unique and never null. Otherwise the rows are written once with generated
    numbers, so that every later read of the result sees the same ones.
    """
    narrow = df.select(F.col(key).try_cast("long").alias("_k"))
    odd = narrow.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).filter("_k is null or n > 1").limit(1).count()
    picked = [F.col(c) for c in columns]
    if not odd:
        return df.select(F.col(key).try_cast("long").alias("_uid"), *picked)
    return materialise(df.select(F.monotonically_increasing_id().alias("_uid"), *picked), "keyed")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with `_nth`, its rows' places from 0 on in that order, written. No task sees more than a range of the rows.

    The rows are dealt out in ranges and sorted there; the driver gets one row per range: how many rows it holds.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(starts, "_p long, _before long")
    out = rows.join(F.broadcast(table), part == F.col("_p"))  # one row a partition
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (place + F.col("_before")).alias("_nth"))


def fields(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The schema of those columns of df, whatever is in them, with more columns as DDL."""
    return T.StructType([*df.select(*columns).schema, *T.StructType.fromDDL(more)])


def growing(df: DataFrame) -> DataFrame:
    """df for the smaller side of a join, where it grows with the input: sorted and merged at every size, never broadcast."""
    return df.hint("merge")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the public SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit word for each byte value, the same in every process."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2^64 and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def utf8_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the UTF-8 bytes of a string or binary column; nulls count as empty."""
    col = batch.column(name)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def word_places(offsets: np.ndarray, data: np.ndarray, seed: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end, hash) of each word `[^\\x20\\x09-\\x0D]+` of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    end = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_table(seed)[data] * up[:n], out=sums[1:])
    return np.searchsorted(offsets, begin, "right") - 1, begin, end, mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def pieces(offsets: np.ndarray, most: int):
    """Cuts rows into consecutive ranges (first, last + 1) of at most `most` bytes, a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
