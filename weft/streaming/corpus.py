"""Structured Streaming corpus ingest (M1) and stream split (M2).

Rows arrive as new Parquet files; each micro-batch is cleaned and given its
stable id, exact duplicates are removed by streaming ``dropDuplicates`` on
the id, the hash split is assigned, and the Parquet sink commits files per
batch. ``availableNow`` processes the backlog and stops.

Exact de-duplication has to remember every id, some 100 bytes each. The ids are
state of the RocksDB store: on the executors' disks, dealt by id over
``spark.sql.shuffle.partitions`` partitions, with changelogs in the checkpoint, so
memory stays bounded, a restart neither re-emits nor loses rows, and ``progress``
tells how much is kept. Where copies arrive within a known delay, ``within`` bounds the
state: ids older than the watermark are forgotten.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.hashing import hash_split, stable_row_id, text_hash_split
from weft.functions.text import clean_text


#: Spark's own store that keeps state on disk
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, unless the session names a store."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    chosen = "HDFSBackedStateStoreProvider" not in (before["spark.sql.streaming.stateStore.providerClass"]
                                                    or "HDFSBackedStateStoreProvider")
    try:
        if not chosen:
            for k, v in _STORE.items():
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def corpus_stream(stream: DataFrame, text_col: str = "text", source_col: str = "source",
                  within: tuple[str, str] | None = None) -> DataFrame:
    """M1 transformation: clean -> drop empty -> id -> exact dedup -> split.

    A null source is hashed as an empty one, as in the batch path, so its rows keep
    distinct ids; the source itself stays null. ``within`` (time column, delay) bounds
    the state: copies are sought within that delay only."""
    cleaned = (stream.withColumn("text", clean_text(text_col))
               .filter(F.col("text") != "")
               .withColumn("id", stable_row_id(F.coalesce(F.col(source_col), F.lit("")), F.col("text"))))
    if within is None:
        unique = cleaned.dropDuplicates(["id"])
    else:
        unique = cleaned.withWatermark(*within).dropDuplicatesWithinWatermark(["id"])
    return unique.withColumn("split", hash_split("id"))


def split_stream(stream: DataFrame, text_col: str = "text", holdout_pct: int = 2) -> DataFrame:
    """M2: stateless hash split of a stream (nothing materialized): the text is
    cleaned, blank rows are dropped, and the cleaned text is hashed."""
    cleaned = stream.withColumn(text_col, clean_text(text_col)).filter(F.col(text_col) != "")
    return cleaned.withColumn("split", text_hash_split(text_col, holdout_pct))


def run_available(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                  transform, out_dir: str, checkpoint: str,
                  max_files_per_trigger: int | None = None, progress: list | None = None) -> DataFrame:
    """Run ``transform`` over every file now in ``source_dir`` (availableNow
    trigger), append to Parquet at ``out_dir``, and return the sink table. ``progress``
    gets (batch, input rows, rows and bytes of state) of every batch that ran."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = transform(reader.parquet(source_dir))
    with state_on_disk(spark):
        q = (out.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    if progress is not None:
        progress += [(p["batchId"], p["numInputRows"], sum(s["numRowsTotal"] for s in p["stateOperators"]),
                      sum(s["memoryUsedBytes"] for s in p["stateOperators"])) for p in q.recentProgress]
    return spark.read.parquet(out_dir)
