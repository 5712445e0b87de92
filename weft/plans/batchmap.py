"""Registered cached batch-transformation queries.

The stand-in clients are deterministic: client A tags a text with ``A:``
but rejects any batch holding a "hard" text (SHA-256 bucket below 20);
client B tags with ``B:`` and always succeeds. So a rejected batch is
halved down to single rows and only hard rows fall through to client B.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from weft.functions.hashing import cache_key, text_hash_bucket
from weft.operators import batchmap as L
from weft.plans import sqlfrag as S
from weft.session import table

QUERIES: dict = {}
ORACLE: dict = {}

DATASET = "benchmark"


def _hard(text: str) -> bool:
    return int(hashlib.sha256(text.encode("utf-8")).hexdigest()[:16], 16) % 100 < 20


def client_a(texts: list[str]) -> list[str]:
    if any(_hard(t) for t in texts):
        raise RuntimeError("batch rejected")
    return [f"A:{t}" for t in texts]


def client_b(texts: list[str]) -> list[str]:
    return [f"B:{t}" for t in texts]


def _cache(spark, sf):
    """The existing cache: about 30 % of the benchmark texts."""
    b = table(spark, sf, "benchmark")
    return b.filter(text_hash_bucket("text") < 30).select(
        cache_key(F.lit(DATASET), "text").alias("cache_key"), F.col("text").alias("source_text"),
        F.concat(F.lit("C:"), F.col("text")).alias("translated_text"),
        F.col("item_id").cast("double").alias("created_at"))


_CACHE_SQL = f"""cache AS (SELECT {S.row_id("'benchmark'", 'text')} AS cache_key, text AS source_text,
                      'C:' || text AS translated_text, CAST(item_id AS DOUBLE) AS created_at
               FROM benchmark WHERE {S.hex_mod100('sha256(text)')} < 30)"""


def _texts(spark, sf):
    b = table(spark, sf, "benchmark").select("text")
    d = table(spark, sf, "documents").select("text")
    return b.unionByName(d)


_TEXTS_SQL = "texts AS (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)"


def plan_pending(spark, sf):
    """L1: distinct texts of benchmark items and documents by status."""
    p = L.plan_pending(_texts(spark, sf), "text", _cache(spark, sf), DATASET)
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES["plan_pending"] = plan_pending
_PLAN_SQL = f"""{_CACHE_SQL}, {_TEXTS_SQL},
planned AS (SELECT d.text, {S.row_id("'benchmark'", 'd.text')} AS cache_key, c.translated_text,
                   CASE WHEN {S.strip("coalesce(d.text, '')")} = '' THEN 'blank'
                        WHEN c.translated_text IS NOT NULL THEN 'cached' ELSE 'pending' END AS status
            FROM (SELECT DISTINCT text FROM texts) d
            LEFT JOIN cache c ON c.cache_key = {S.row_id("'benchmark'", 'd.text')})"""
ORACLE["plan_pending"] = f"WITH {_PLAN_SQL} SELECT status, count(*) AS n FROM planned GROUP BY status"


def greedy_batches(spark, sf):
    """documents in doc_id order, at most 8 rows and 20,000 characters per batch."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return L.greedy_batches(d, ["doc_id"], "text", 8, 20_000).select("doc_id", "batch")


QUERIES["greedy_batches"] = greedy_batches
ORACLE["greedy_batches"] = """
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, coalesce(length(text), 0) AS n FROM documents),
b AS (SELECT doc_id, i, 1 AS held, n AS chars, CAST(0 AS BIGINT) AS batch FROM d WHERE i = 1
      UNION ALL
      SELECT d.doc_id, d.i, CASE WHEN held >= 8 OR chars + n > 20000 THEN 1 ELSE held + 1 END,
             CASE WHEN held >= 8 OR chars + n > 20000 THEN n ELSE chars + n END,
             CASE WHEN held >= 8 OR chars + n > 20000 THEN batch + 1 ELSE batch END
      FROM b JOIN d ON d.i = b.i + 1)
SELECT doc_id, batch FROM b
"""


def greedy_batches_rows(spark, sf):
    """F15 size-only case: batches of 8 rows (no character limit)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return L.greedy_batches(d, ["doc_id"], "text", 8, 1 << 62).select("doc_id", "batch")


QUERIES["greedy_batches_rows"] = greedy_batches_rows
ORACLE["greedy_batches_rows"] = """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 8 AS BIGINT) AS batch FROM documents
"""


def _results(spark, sf):
    p = L.plan_pending(_texts(spark, sf), "text", _cache(spark, sf), DATASET)
    pending = p.filter(F.col("status") == "pending").select("cache_key", "text")
    batches = L.greedy_batches(pending, ["cache_key"], "text", 4, 2_000)
    return L.apply_batches(batches, [client_a, client_b], retries=0)


def apply_batches(spark, sf):
    """L2: pending texts through client A, halving rejected batches, client B
    for the hard rows."""
    r = _results(spark, sf)
    return r.select("cache_key", F.sha2("translated_text", 256).alias("translated_text"), "client", "error")


QUERIES["apply_batches"] = apply_batches
_HARD = S.hex_mod100("sha256(text)") + " < 20"
_RES_SQL = f"""{_PLAN_SQL},
results AS (SELECT cache_key, CASE WHEN {_HARD} THEN 'B:' || text ELSE 'A:' || text END AS translated_text,
                   CAST(CASE WHEN {_HARD} THEN 1 ELSE 0 END AS INTEGER) AS client, NULL::VARCHAR AS error
            FROM planned WHERE status = 'pending')"""
ORACLE["apply_batches"] = f"""
WITH {_RES_SQL} SELECT cache_key, sha256(translated_text) AS translated_text, client, error FROM results
"""


def cache_upsert(spark, sf):
    """L3: new results (newer timestamps) merged into the cache."""
    cache = _cache(spark, sf)
    r = _results(spark, sf).join(
        _texts(spark, sf).select(cache_key(F.lit(DATASET), "text").alias("cache_key"),
                                 F.col("text").alias("source_text")).distinct(), "cache_key")
    new = r.select("cache_key", "source_text", "translated_text", F.lit(2e9).alias("created_at"))
    up = L.cache_upsert(cache, new)
    return up.select("cache_key", F.sha2("translated_text", 256).alias("translated_text"), "created_at")


QUERIES["cache_upsert"] = cache_upsert
ORACLE["cache_upsert"] = f"""
WITH {_RES_SQL},
u AS (SELECT cache_key, translated_text, created_at FROM cache
      UNION ALL SELECT cache_key, translated_text, 2e9 FROM results)
SELECT cache_key, sha256(arg_max(translated_text, created_at)) AS translated_text, max(created_at) AS created_at
FROM u GROUP BY cache_key
"""


def restore_rows(spark, sf):
    """L4: every benchmark row with its translation (cached or new); none missing."""
    cache = _cache(spark, sf)
    r = _results(spark, sf).select("cache_key", "translated_text")
    allres = cache.select("cache_key", "translated_text").unionByName(r)
    out = L.restore_rows(table(spark, sf, "benchmark"), "text", allres, DATASET)
    return out.select("item_id", F.sha2("translated_text", 256).alias("translated_text"))


QUERIES["restore_rows"] = restore_rows
ORACLE["restore_rows"] = f"""
WITH {_RES_SQL},
allres AS (SELECT cache_key, translated_text FROM cache UNION ALL SELECT cache_key, translated_text FROM results)
SELECT b.item_id, sha256(a.translated_text) AS translated_text FROM benchmark b
LEFT JOIN allres a ON a.cache_key = {S.row_id("'benchmark'", 'b.text')}
"""
