"""Helpers shared by the training-data operators.

Routing: several operators need, for every document, a sum over values that
live in a table keyed by words, pre-tokens or n-grams, a table too large to
broadcast. ``blocks`` groups the documents of a task into blocks of bounded
size; a block sends each shard one row with the block's *distinct* keys of
that shard and the documents that hold them, so a frequent key costs one entry
per block, never one row per occurrence. Rows of a block are numbered, and the
numbering is only stable when the input is read in the same order again:
pass a scan, a checkpoint or a sorted frame.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import ensure_checkpoint_dir, ship_package

#: a block of documents is closed at this many bytes of text or documents
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 15


def prepare(spark: SparkSession) -> None:
    """Make the package importable in workers and name the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, shared by driver and executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/weft-llm/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder as Parquet and read it back:
    the result survives lost executors and is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Number of tasks that read ``df``: it grows with the input."""
    return max(1, df.rdd.getNumPartitions())


def shards_for(df: DataFrame) -> int:
    """Number of shards for keys gathered from ``df``: one per input task, and
    enough for every core."""
    return max(partitions(df), df.sparkSession.sparkContext.defaultParallelism)


def documents_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as UTF-8 bytes) under fixed names; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def trim() -> None:
    """Give memory that was freed back to the system: workers live on from task to
    task, and what their allocators keep adds up beside the executor's heap."""
    import ctypes
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Block:
    """Consecutive documents of one task."""

    __slots__ = ("number", "ids", "texts", "flags")

    def __init__(self, number: int):
        self.number, self.ids, self.texts, self.flags = number, [], [], []


def blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = BLOCK_BYTES,
           max_docs: int = BLOCK_DOCS) -> Iterator[Block]:
    """Blocks of (id, text[, flag]) rows of this task, numbered across the job."""
    from pyspark import TaskContext
    ctx = TaskContext.get()
    number = (ctx.partitionId() if ctx else 0) << 32
    block, size = Block(number), 0
    for batch in batches:
        flags = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for i, t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), flags, strict=True):
            block.ids.append(i)
            block.texts.append(t)
            block.flags.append(f)
            size += len(t)
            if size >= max_bytes or len(block.ids) >= max_docs:
                yield block
                number += 1
                block, size = Block(number), 0
                trim()
    if block.ids:
        yield block
    del block
    trim()


class Ids(dict):
    """Numbers values in order of first sight: ``list(map(ids.__getitem__, values))``."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Hashes(dict):
    """xxh3-64 of words, remembered (the memory is emptied at ``limit`` words)."""

    def __init__(self, limit: int = 1 << 20):
        super().__init__()
        import xxhash
        self._h, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        v = self[key] = self._h(key)
        return v

    def array(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort of numbers is several times faster than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def starts(sizes) -> np.ndarray:
    """Offsets of groups laid out one after the other, with the end."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string: their byte lengths, then their bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, k in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, k, n // np.dtype(k).itemsize, at))
        at += n
    return out


def text_hash(text_col: str):
    """64-bit hash of a text; a null text hashes as an empty one. With the id it
    names a row: rows that agree in both are copies of each other."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


#: (id, text hash) rows, some 24 bytes each, sent to every executor at most
BROADCAST_KEYS = 1 << 20


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) isn't in ``keys`` (columns ``_id`` and
    ``_hash``). Few keys are broadcast; many are joined by a shuffle."""
    keys = kept(keys.select("_id", "_hash").distinct(), "dropped")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(side, text_hash(text_col).eqNullSafe(F.col("_hash"))
                     & F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left_anti")
