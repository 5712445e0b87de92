"""Registered retrieval queries on relevance judgements: every vector is a query
and a document under string ids; judged relevant are the vector itself and the next
and previous one of its label (by vec_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import metrics as M
from weft.operators import retrieval as R
from weft.operators.ordering import global_index
from weft.plans.vectors import VN_SQL, ir_sql
from weft.session import cut_lineage, table

QUERIES: dict = {}
ORACLE: dict = {}


def _parts(spark, sf):
    e = table(spark, sf, "embeddings")
    name = lambda p, c="vec_id": F.concat(F.lit(p), F.col(c).cast("string"))
    queries = e.select(name("q").alias("qid"), F.col("embedding").alias("vec"))
    corpus = e.select(name("d").alias("did"), F.col("embedding").alias("vec"))
    at = cut_lineage(global_index(e.select("label", "vec_id"), ["label", "vec_id"], "_i"))
    near = at.select("label", F.col("vec_id").alias("_other"), F.explode(F.array(
        F.col("_i") - 1, F.col("_i"), F.col("_i") + 1)).alias("_i"))
    qrels = at.join(near, ["label", "_i"]).select(name("q").alias("qid"), name("d", "_other").alias("did"))
    return queries, corpus, qrels


_QRELS_SQL = VN_SQL + """,
placed AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS i FROM embeddings),
qrels AS (SELECT 'q' || a.vec_id AS qid, 'd' || b.vec_id AS did FROM placed a JOIN placed b
          ON a.label = b.label AND b.i BETWEEN a.i - 1 AND a.i + 1),
scored AS (SELECT 'q' || a.vec_id AS qid, 'd' || b.vec_id AS did,
                  CASE WHEN a.nrm * b.nrm > 0 THEN list_dot_product(a.e, b.e) / (a.nrm * b.nrm) ELSE 0 END AS score
           FROM vn a, vn b),
judged AS (SELECT s.*, CASE WHEN r.did IS NULL THEN 0 ELSE 1 END AS rel FROM scored s LEFT JOIN qrels r USING (qid, did))"""


def retrieval_metrics(spark, sf):
    """I2 on judgements: accuracy, precision, recall, MRR, NDCG and MAP over string ids."""
    return M.mean_metrics(R.retrieval_metrics(*_parts(spark, sf)))


QUERIES["retrieval_metrics"] = retrieval_metrics
ORACLE["retrieval_metrics"] = f"WITH {_QRELS_SQL}, {ir_sql('judged')} SELECT * FROM ir"


def retrieval_ranks(spark, sf):
    """I4 on judgements: rank of each query's best judged document that isn't itself."""
    queries, corpus, qrels = _parts(spark, sf)
    others = qrels.filter(F.substring("qid", 2, 20) != F.substring("did", 2, 20))
    return R.retrieval_ranks(queries, corpus, others).select("qid", F.col("rank").cast("bigint").alias("rank"))


QUERIES["retrieval_ranks"] = retrieval_ranks
ORACLE["retrieval_ranks"] = f"""
WITH {_QRELS_SQL},
best AS (SELECT qid, max(score) AS b FROM judged WHERE rel = 1 AND substr(qid, 2) <> substr(did, 2) GROUP BY qid)
SELECT qid, 1 + CAST(count_if(score > b + 1e-9) AS BIGINT) AS rank FROM judged JOIN best USING (qid) GROUP BY qid
"""
