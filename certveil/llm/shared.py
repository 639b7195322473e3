"""What the operators of this subpackage share: the shared folder, written tables, joins that split hot keys, row grouping."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, shared_dir, split_join

__all__ = ["shared_dir", "split_join"]
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27  # of the bitmap that says which texts are needed; MOST_BITS are some 64 MB to broadcast
_paths: dict[str, list[str]] = {}  # by application: the tables written, until they are released


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that the operators wrote so far. Call it once their results are saved or no longer needed."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None]) -> None:
    """On a worker: ``name`` begins to keep a cache; those that other operators left in this process go, and freed memory with them."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    _held[name] = release
    trim()


def trim() -> None:
    """Freed memory of this process back to the system: Arrow's pool and the C library keep it otherwise, in idle workers too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow without a cache: those of other operators go before it, freed memory after it."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(name, lambda: None)
        yield from run(batches)
        trim()

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer splits than there are cores (a small single file) are dealt out."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name in ("documents", "pages", "conversations") else rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Each run of rows with equal ``keys``, from rows sorted by them, with its slices one after the other. A run is never held whole."""
    source = ((k, part) for batch in batches for k, part in _runs(batch, keys))
    pending = next(source, None)

    def same(key):
        nonlocal pending
        while pending is not None and pending[0] == key:
            part = pending[1]
            pending = next(source, None)
            yield part

    while pending is not None:
        key = pending[0]
        run = same(key)
        yield key, run
        for _ in run:  # what the caller left
            pass


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    rows = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield rows[start], batch.slice(start, i - start)
            start = i


def _marked(docs: DataFrame, ids: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """The rows of ``docs`` (column row) with a bitmap of ``ids`` (column doc) beside them, and whether a row's bit is set. The bitmap's size follows the count of ids."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, mask = F.expr("shiftright(bit, 6)").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")
    bitmap = ids.select(bit("doc").alias("bit")).select(word, mask).groupBy("word").agg(F.expr("bit_or(mask)").alias("bits"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), bit("doc_id").alias("bit")).select("row", word, mask)
    return rows.join(F.broadcast(bitmap), "word", how), F.coalesce(F.expr("(bits & mask) <> 0"), F.lit(False))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be among ``ids`` (column doc): all that are, and few others while the bitmap is sparse."""
    rows, hit = _marked(docs.select("doc_id", "text"), ids, "inner")
    return rows.where(hit).select(F.col("row.doc_id").alias("doc"), "row.text")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids`` (column doc); only rows whose bit is set travel. Null ids stay."""
    rows, hit = _marked(docs, ids, "left")
    gone = ids.where("doc is not null").select(F.col("doc").alias("doc_id")).distinct()
    doubtful = rows.where(hit).select("row.*").join(gone, "doc_id", "left_anti")
    return rows.where(~hit).select("row.*").unionByName(doubtful.select(docs.columns))
