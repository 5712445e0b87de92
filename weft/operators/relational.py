"""Joins and set operations.

Small sides (id lists of a test set, caches of bounded size, per-split
metrics) are joined with plain equi-joins; AQE turns them into broadcasts
when the measured side is small and splits skewed partitions otherwise.
Set operations are bag-safe: ``left_anti`` keeps duplicates of the left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anti_join_ids(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return df.join(ids.select(*([key] if isinstance(key, str) else key)), key, "left_anti")


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(*([key] if isinstance(key, str) else key)), key, "left_semi")


def join_metrics(coverage: DataFrame, metrics: DataFrame, on: str = "split") -> DataFrame:
    """Per-split coverage next to per-split metrics; AQE broadcasts what is small."""
    return coverage.join(metrics, on, "inner")


def cache_lookup(df: DataFrame, cache: DataFrame, key_col: str = "cache_key",
                 value_col: str = "translated_text") -> DataFrame:
    """Attach the cached value (NULL = miss) and a ``hit`` flag."""
    c = cache.select(key_col, value_col)
    return (df.join(c, key_col, "left")
            .withColumn("hit", F.col(value_col).isNotNull()))


def resume_pending(work: DataFrame, done: DataFrame, key: str, config_hash: str) -> DataFrame:
    """E5: work items not yet completed under the same configuration hash."""
    done_keys = done.filter(F.col("config_hash") == config_hash).select(key)
    return work.join(done_keys, key, "left_anti")


def relevance_sets(df: DataFrame, query_key: str, positive_col: str) -> DataFrame:
    """Qrels rows (query key, relevant positive): every positive of every
    row whose normalized query equals the key. Long form, so a query repeated
    very often yields its distinct positives once, never all pairs of rows."""
    return df.select(F.col(query_key).alias("query_key"),
                     F.col(positive_col).alias("positive")).distinct()


def text_to_id(df: DataFrame, text_col: str, dictionary: DataFrame,
               out_col: str = "doc_index") -> DataFrame:
    """Map text to its dictionary index (join on SHA-256 of the text)."""
    d = dictionary.select(F.col("text_hash").alias("_th"), F.col("doc_index").alias(out_col))
    return (df.withColumn("_th", F.sha2(F.col(text_col), 256))
            .join(d, "_th", "left").drop("_th"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """G1: union by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows present in both."""
    return a.intersect(b)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Set union."""
    return union_all(frames).distinct()
