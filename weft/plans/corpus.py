"""Registered corpus-build queries (entry slice, C1, F1-F4, B4-B7 on documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import hashing as H
from weft.operators import corpus as C
from weft.plans import sqlfrag as S
from weft.session import cut_lineage, table

QUERIES: dict = {}
ORACLE: dict = {}


def corpus_counts(spark, sf):
    """Flagship: documents -> B1 -> B4 -> C1 -> F1/F3 -> B5 -> D10."""
    corpus = C.build_corpus(table(spark, sf, "documents"))
    return C.counts_by_source_split(corpus)


QUERIES["corpus_counts"] = corpus_counts
ORACLE["corpus_counts"] = f"""
WITH {S.CORPUS_ROWS},
sizes AS (SELECT source, count(*) AS n FROM corpus_rows GROUP BY source),
alloc AS (
  SELECT source, n, CAST(floor(sum(n) OVER () * 0.6) AS BIGINT) AS t, sum(n) OVER () AS w FROM sizes),
alloc2 AS (SELECT source, (t * n) // w AS base, (t * n) % w AS rem, t FROM alloc),
alloc3 AS (SELECT source, base, row_number() OVER (ORDER BY rem DESC, source) AS rk,
                  t - sum(base) OVER () AS lft FROM alloc2),
quotas AS (SELECT source, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM alloc3),
picked AS (
  SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
                   FROM corpus_rows) r JOIN quotas q USING (source) WHERE rn <= quota)
SELECT source, {S.hash_split('id')} AS split, count(*) AS n FROM picked GROUP BY 1, 2
"""


def dedup_first(spark, sf):
    """First row per stable id, by doc_id."""
    rows = C.prepare_corpus_rows(table(spark, sf, "documents"))
    return rows.select("id", "doc_id", "source", F.length("text").cast("bigint").alias("chars"))


QUERIES["dedup_first"] = dedup_first
ORACLE["dedup_first"] = f"""
WITH {S.CORPUS_ROWS}
SELECT id, doc_id, source, CAST(length(text) AS BIGINT) AS chars FROM corpus_rows
"""


def stable_row_id(spark, sf):
    """B4 + B5 + B6 + B7(default) per document."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        H.stable_row_id("source", "text").alias("id"),
        H.hash_split(H.stable_row_id("source", "text")).alias("split"),
        H.cache_key(F.lit("documents"), "text").alias("cache_key"),
        H.text_hash_split("text").alias("mlm_split"))


QUERIES["stable_row_id"] = stable_row_id
ORACLE["stable_row_id"] = f"""
SELECT doc_id, {S.row_id('source', 'text')} AS id,
       {S.hash_split(S.row_id('source', 'text'))} AS split,
       {S.row_id("'documents'", 'text')} AS cache_key,
       CASE WHEN {S.hex_mod100('sha256(text)')} < 2 THEN 'eval' ELSE 'train' END AS mlm_split
FROM documents
"""


def quota_largest_remainder(spark, sf):
    """split the order total of each region's customers... over nations.

    Weights = customers per nation; total = number of orders; index = nation key.
    """
    cust = table(spark, sf, "customer")
    orders = table(spark, sf, "orders")
    weights = cust.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("w"))
    total = orders.agg(F.count(F.lit(1)).alias("t"))
    w = weights.crossJoin(F.broadcast(total))  # one-row table
    return C.quota_largest_remainder(w, F.col("t"), "w", "c_nationkey").select(
        "c_nationkey", "w", "quota")


QUERIES["quota_largest_remainder"] = quota_largest_remainder
ORACLE["quota_largest_remainder"] = """
WITH w AS (SELECT c_nationkey, count(*) AS w FROM customer GROUP BY 1),
t AS (SELECT count(*) AS t FROM orders),
a AS (SELECT c_nationkey, w, (t * w) // sum(w) OVER () AS base, (t * w) % sum(w) OVER () AS rem, t
      FROM w, t),
b AS (SELECT *, row_number() OVER (ORDER BY rem DESC, c_nationkey) AS rk,
             t - sum(base) OVER () AS lft FROM a)
SELECT c_nationkey, w, CAST(base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b
"""


def corpus_quotas(spark, sf):
    """60/20/20 of the document count over the document sources (the
    first two sources by name fixed, the rest share the last 20 %)."""
    d = table(spark, sf, "documents")
    total = d.agg(F.count(F.lit(1)).alias("t"))
    return C.corpus_quotas(d.select("source"), total, "source")


QUERIES["corpus_quotas"] = corpus_quotas
ORACLE["corpus_quotas"] = """
WITH t AS (SELECT count(*) AS t FROM documents),
tiers AS (SELECT * FROM (VALUES (0, 60), (1, 20), (2, 20)) v(tier, weight)),
ta AS (SELECT tier, (t * weight) // 100 AS base, (t * weight) % 100 AS rem, t FROM tiers, t),
tb AS (SELECT tier, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, tier)
                                    <= t - sum(base) OVER () THEN 1 ELSE 0 END AS tq FROM ta),
src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)),
fixed AS (SELECT source, tq AS quota FROM src JOIN tb ON tb.tier = src.i WHERE src.i < 2),
sh AS (SELECT source, i, (SELECT tq FROM tb WHERE tier = 2) AS t, count(*) OVER () AS w FROM src WHERE i >= 2),
sh2 AS (SELECT source, i, t // w AS base, t % w AS rem, t FROM sh),
sh3 AS (SELECT source, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, i)
                                      <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM sh2)
SELECT source, CAST(quota AS BIGINT) AS quota FROM fixed
UNION ALL SELECT source, CAST(quota AS BIGINT) AS quota FROM sh3
"""


def take_quota(spark, sf):
    """first 30 % of every source's unique rows (largest remainder), by doc_id."""
    rows = cut_lineage(C.prepare_corpus_rows(table(spark, sf, "documents")))  # read twice
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    quotas = sizes.withColumn("quota", F.floor(F.col("n") * 0.3).cast("bigint"))
    picked = C.take_quota(rows, quotas, "source", ["doc_id"])
    return picked.select("source", "doc_id", "id")


QUERIES["take_quota"] = take_quota
ORACLE["take_quota"] = f"""
WITH {S.CORPUS_ROWS},
q AS (SELECT source, CAST(floor(count(*) * 0.3) AS BIGINT) AS quota FROM corpus_rows GROUP BY 1)
SELECT source, doc_id, id FROM (
  SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM corpus_rows r)
JOIN q USING (source) WHERE rn <= quota
"""


def round_robin_quota(spark, sf):
    """a shared quota of 40 % of the document count, one row per source per round.

    Sources are taken in name order; each source's rows in doc_id order.
    """
    rows = C.prepare_corpus_rows(table(spark, sf, "documents"))
    total = int(table(spark, sf, "documents").count() * 0.4)  # parquet footer count
    picked = C.round_robin_quota(rows, "source", ["doc_id"], total)
    return picked.select("source", "doc_id", F.col("round").cast("bigint").alias("round"))


QUERIES["round_robin_quota"] = round_robin_quota
ORACLE["round_robin_quota"] = f"""
WITH {S.CORPUS_ROWS},
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round
      FROM corpus_rows)
SELECT source, doc_id, CAST(round AS BIGINT) AS round FROM r
ORDER BY round, source
LIMIT (SELECT CAST(floor(count(*) * 0.4) AS BIGINT) FROM documents)
"""


def counts_by_source_split(spark, sf):
    """Rows per (source, split) of the whole de-duplicated corpus."""
    from weft.functions.hashing import hash_split
    rows = C.prepare_corpus_rows(table(spark, sf, "documents"))
    return C.counts_by_source_split(rows.withColumn("split", hash_split("id")))


QUERIES["counts_by_source_split"] = counts_by_source_split
ORACLE["counts_by_source_split"] = f"""
WITH {S.CORPUS_ROWS} SELECT source, {S.hash_split('id')} AS split, count(*) AS n FROM corpus_rows GROUP BY 1, 2
"""


def hash_split(spark, sf):
    """2 % validation by the first 64 bits of each conversation turn's id."""
    c = table(spark, sf, "conversations")
    rid = H.stable_row_id(F.col("role"), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", H.hash_split(rid).alias("split"))


QUERIES["hash_split"] = hash_split
ORACLE["hash_split"] = f"""
SELECT conv_id, turn, {S.hash_split(S.row_id('role', "coalesce(text, '')"))} AS split FROM conversations
"""


def cache_key(spark, sf):
    """Translation-cache keys of benchmark items and page urls."""
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("id"),
                                             H.cache_key(F.lit("benchmark"), "text").alias("cache_key"))
    p = table(spark, sf, "pages").select(F.lit("pages").alias("dataset"), F.col("page_id").alias("id"),
                                         H.cache_key(F.lit("pages"), "url").alias("cache_key"))
    return b.unionByName(p)


QUERIES["cache_key"] = cache_key
ORACLE["cache_key"] = f"""
SELECT 'benchmark' AS dataset, item_id AS id, {S.row_id("'benchmark'", 'text')} AS cache_key FROM benchmark
UNION ALL SELECT 'pages', page_id, {S.row_id("'pages'", 'url')} FROM pages
"""


def text_hash_split(spark, sf):
    """B7 (default): 2 % hold-out by SHA-256 of the conversation text alone."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", H.text_hash_split(F.coalesce("text", F.lit(""))).alias("split"))


QUERIES["text_hash_split"] = text_hash_split
ORACLE["text_hash_split"] = f"""
SELECT conv_id, turn, CASE WHEN {S.hex_mod100("sha256(coalesce(text, ''))")} < 2 THEN 'eval' ELSE 'train' END AS split
FROM conversations
"""


def text_hash_split_exact(spark, sf):
    """B7 (exact): BLAKE2b-64 of the text, as the reference computes it (Arrow UDF)."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", H.text_hash_split(F.coalesce("text", F.lit("")), exact=True).alias("split"))


QUERIES["text_hash_split_exact"] = text_hash_split_exact  # no BLAKE2b in DuckDB: rows-only; tests use hashlib
