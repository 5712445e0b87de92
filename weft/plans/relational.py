"""Registered join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.hashing import cache_key, stable_row_id, text_hash_bucket
from weft.functions.text import word_count
from weft.operators import profile as P
from weft.operators import relational as R
from weft.operators.ordering import split_three_way
from weft.plans import sqlfrag as S
from weft.plans.audit import KEY_SQL, candidate_dictionary, query_key
from weft.plans.fixtures import CORPUS_SPLIT_SQL, QA_ROWS_SQL, corpus_with_split, qa_rows
from weft.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def anti_join_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return R.anti_join_ids(d, table(spark, sf, "labels"), "doc_id")


QUERIES["anti_join_ids"] = anti_join_ids
ORACLE["anti_join_ids"] = """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""


def semi_join_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1)
    return R.semi_join_ids(d, toxic, "doc_id")


QUERIES["semi_join_ids"] = semi_join_ids
ORACLE["semi_join_ids"] = """
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
"""


def join_metrics(spark, sf):
    """Split coverage next to per-split length metrics."""
    c = corpus_with_split(spark, sf)
    cov = P.split_coverage(c, "split", ["lang", "source"])
    met = c.groupBy("split").agg(F.round(F.avg(word_count("text")), 6).alias("mean_words"))
    return R.join_metrics(cov, met, "split")


QUERIES["join_metrics"] = join_metrics
ORACLE["join_metrics"] = f"""
WITH {CORPUS_SPLIT_SQL}
SELECT split, count(*) AS rows, count(DISTINCT lang) AS distinct_lang,
       count(DISTINCT source) AS distinct_source, round(avg({S.words('text')}), 6) AS mean_words
FROM corpus_split GROUP BY split
"""


def _cache(spark, sf):
    """A translation cache holding about 30 % of the benchmark texts."""
    b = table(spark, sf, "benchmark")
    return (b.filter(text_hash_bucket("text") < 30)
            .select(cache_key(F.lit("benchmark"), "text").alias("cache_key"),
                    F.upper("text").alias("translated_text"),
                    F.col("item_id").cast("double").alias("created_at")))


_CACHE_SQL = f"""cache AS (
  SELECT {S.row_id("'benchmark'", 'text')} AS cache_key, upper(text) AS translated_text,
         CAST(item_id AS DOUBLE) AS created_at FROM benchmark WHERE {S.hex_mod100('sha256(text)')} < 30)"""


def cache_lookup(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("cache_key", cache_key(F.lit("benchmark"), "text"))
    out = R.cache_lookup(b, _cache(spark, sf))
    return out.select("item_id", "hit", F.sha2("translated_text", 256).alias("translated_hash"))


QUERIES["cache_lookup"] = cache_lookup
ORACLE["cache_lookup"] = f"""
WITH {_CACHE_SQL}
SELECT item_id, c.translated_text IS NOT NULL AS hit, sha256(c.translated_text) AS translated_hash
FROM benchmark b LEFT JOIN cache c ON c.cache_key = {S.row_id("'benchmark'", 'b.text')}
"""

_CONFIG = "sha2-hash-encoder|rev1|passage|512|fp|float32"


def resume_pending(spark, sf):
    """E5: document ids not yet embedded under the current configuration.

    Labelled documents stand for finished work; the toxic ones were finished
    under an older configuration, so they are pending again.
    """
    d = table(spark, sf, "documents")
    work = d.select("doc_id", stable_row_id("source", "text").alias("id"))
    lab = table(spark, sf, "labels").join(d.select("doc_id", "source", "text"), "doc_id")
    done = lab.select(stable_row_id("source", "text").alias("id"),
                      F.when(F.col("toxic") == 1, F.sha2(F.lit("old"), 256))
                      .otherwise(F.sha2(F.lit(_CONFIG), 256)).alias("config_hash"))
    cfg = spark.range(1).select(F.sha2(F.lit(_CONFIG), 256).alias("h")).first()["h"]
    return R.resume_pending(work, done, "id", cfg)


QUERIES["resume_pending"] = resume_pending
ORACLE["resume_pending"] = f"""
WITH w AS (SELECT doc_id, {S.row_id('source', 'text')} AS id FROM documents),
done AS (SELECT {S.row_id('d.source', 'd.text')} AS id FROM labels l JOIN documents d USING (doc_id)
         WHERE l.toxic <> 1)
SELECT doc_id, id FROM w WHERE id NOT IN (SELECT id FROM done)
"""


def relevance_sets(spark, sf):
    qa = qa_rows(spark, sf).withColumn("qkey", query_key()) \
        .withColumn("doc_hash", F.sha2("document", 256))
    return R.relevance_sets(qa, "qkey", "doc_hash")


QUERIES["relevance_sets"] = relevance_sets
ORACLE["relevance_sets"] = f"""
WITH {QA_ROWS_SQL}
SELECT DISTINCT {KEY_SQL} AS query_key, sha256(document) AS positive FROM qa_rows
"""


def text_to_id(spark, sf):
    """Each row's first negative -> its candidate-dictionary index."""
    qa = qa_rows(spark, sf).select("row_id", "negative1")
    return R.text_to_id(qa, "negative1", candidate_dictionary(spark, sf)).drop("negative1")


QUERIES["text_to_id"] = text_to_id
ORACLE["text_to_id"] = f"""
WITH {QA_ROWS_SQL},
st AS (SELECT row_id, 0 AS pos, document AS text FROM qa_rows
       UNION ALL SELECT row_id, 1, negative1 FROM qa_rows
       UNION ALL SELECT row_id, 2, negative2 FROM qa_rows
       UNION ALL SELECT row_id, 3, negative3 FROM qa_rows),
f AS (SELECT sha256(text) AS text_hash, min(row_id * 4 + pos) AS o FROM st GROUP BY 1),
dict AS (SELECT text_hash, row_number() OVER (ORDER BY o) - 1 AS doc_index FROM f)
SELECT row_id, doc_index FROM qa_rows q LEFT JOIN dict ON dict.text_hash = sha256(q.negative1)
"""


def union_all(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = table(spark, sf, "benchmark").select("item_id", "text")
    u = R.union_all([d, c, b])
    return u.withColumn("text", F.sha2("text", 256))


QUERIES["union_all"] = union_all
ORACLE["union_all"] = """
SELECT doc_id, source, sha256(text) AS text, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn,
       NULL::BIGINT AS item_id FROM documents
UNION ALL SELECT NULL, NULL, sha256(text), conv_id, turn, NULL FROM conversations
UNION ALL SELECT NULL, NULL, sha256(text), NULL, NULL, item_id FROM benchmark
"""


def except_ids(spark, sf):
    """All documents - test - valid (bag-safe) = train."""
    d = table(spark, sf, "documents").select("doc_id")
    s = split_three_way(d, 10, ["doc_id"], copy_below=5)
    test = s.filter(F.col("split") == "test").select("doc_id")
    valid = s.filter(F.col("split") == "valid").select("doc_id")
    return R.anti_join_ids(R.anti_join_ids(d, test, "doc_id"), valid, "doc_id")


QUERIES["except_ids"] = except_ids
ORACLE["except_ids"] = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.order_key(10, 'doc_id')}) - 1 AS i,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE i >= CAST(ceil(0.2 * n) AS BIGINT)
"""


def intersect_keys(spark, sf):
    """Keys of whole normalized texts present in both corpus splits."""
    c = corpus_with_split(spark, sf).withColumn(
        "key", query_key("text"))
    a = c.filter(F.col("split") == "train").select("key")
    b = c.filter(F.col("split") == "validation").select("key")
    return R.intersect_keys(a, b)


QUERIES["intersect_keys"] = intersect_keys
_KEY_SQL = KEY_SQL.replace("lower(query)", "lower(text)")
ORACLE["intersect_keys"] = f"""
WITH {CORPUS_SPLIT_SQL}
SELECT {_KEY_SQL} AS key FROM corpus_split WHERE split = 'train'
INTERSECT SELECT {_KEY_SQL} FROM corpus_split WHERE split = 'validation'
"""


def union_distinct(spark, sf):
    """Sources with a toxic label, united with sources with a low-quality label."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    lab = table(spark, sf, "labels").join(d, "doc_id")
    a = lab.filter(F.col("toxic") == 1).select("source")
    b = lab.filter(F.col("quality") == 0).select("source")
    return R.union_distinct([a, b])


QUERIES["union_distinct"] = union_distinct
ORACLE["union_distinct"] = """
SELECT source FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
UNION SELECT source FROM labels JOIN documents USING (doc_id) WHERE quality = 0
"""
