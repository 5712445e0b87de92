"""Retrieval evaluation over queries, a corpus and relevance judgements.

Ids may be strings or numbers. Judgements (qrels) are rows (group.., qid, did);
several positives per query are several rows. Strings are numbered in their order
for the block step, so ties still go to the lower id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import metrics as M
from weft.operators import vectors as V
from weft.operators.ordering import global_index
from weft.session import cut_lineage


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with its ids as positions in id order, the table (_name, _no))."""
    ids = df.select(F.col(id_col).alias("_name")).distinct()
    names = cut_lineage(global_index(ids, ["_name"], "_no"))
    return df.join(names, df[id_col] == names["_name"]).withColumn(id_col, F.col("_no")).drop("_name", "_no"), names


def _named(df: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    return df.join(names, df[id_col] == names["_no"]).withColumn(id_col, F.col("_name")).drop("_name", "_no")


def judged(qrels: DataFrame, queries: DataFrame, corpus: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Distinct judgements whose query and document are there."""
    g = list(group)
    return (qrels.select(*g, "qid", "did").distinct()
            .join(queries.select(*g, "qid"), [*g, "qid"], "left_semi")
            .join(corpus.select(*g, "did"), [*g, "did"], "left_semi"))


def ranked_hits(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, k: int = 100,
                group: Sequence[str] = ()) -> DataFrame:
    """(group.., qid, did, score, rank, rel): the k best documents of every query."""
    g = list(group)
    q, q_names = numbered(queries, "qid")
    d, d_names = numbered(corpus, "did")
    top = _named(_named(V.top_k(q, d, k, g), q_names, "qid"), d_names, "did")
    rel = qrels.select(*g, "qid", "did").distinct().withColumn("_rel", F.lit(1))
    return top.join(rel, [*g, "qid", "did"], "left").withColumn("rel", F.coalesce("_rel", F.lit(0))).drop("_rel")


def retrieval_metrics(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per-query values (queries without judged documents are left out);
    ``metrics.mean_metrics`` averages them (I12: per group)."""
    g = list(group)
    rels = cut_lineage(judged(qrels, queries, corpus, g))
    counts = rels.groupBy(*g, "qid").agg(F.count(F.lit(1)).alias("R"))
    return M.ir_per_query(ranked_hits(queries, corpus, rels, 100, g), counts, g)


def retrieval_ranks(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """I4: (group.., qid, best_relevant, rank): 1 + the documents that score above the
    query's best judged one. The best is found by a join on the judgements; only the
    count needs all documents."""
    g = list(group)
    rels = judged(qrels, queries, corpus, g)
    pairs = rels.join(queries.select(*g, "qid", F.col("vec").alias("_q")), [*g, "qid"]).join(
        corpus.select(*g, "did", F.col("vec").alias("_d")), [*g, "did"])
    best = cut_lineage(pairs.groupBy(*g, "qid").agg(F.max(V.cosine("_q", "_d")).alias("best_relevant")))
    q, q_names = numbered(queries.select(*g, "qid", "vec").join(best, [*g, "qid"]).withColumnRenamed(
        "best_relevant", "thr"), "qid")
    d, _ = numbered(corpus.select(*g, "did", "vec"), "did")
    above = V.block_pairs(q, d, "count_above", 0, g).groupBy(*g, "qid").agg(F.sum("value").cast("bigint").alias("_n"))
    return best.join(_named(above, q_names, "qid"), [*g, "qid"]).select(
        *g, "qid", "best_relevant", (F.col("_n") + 1).alias("rank"))


def pairs_to_ir(pairs: DataFrame, order: Sequence[str], query_col: str, document_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries (qid, text), corpus (did, text), qrels (qid, did)) of text pairs.

    Pair i in ``order`` gives ``q{i}`` and ``d{i}``; i counts all pairs, and pairs with
    a text that is blank once stripped are left out after that."""
    from weft.functions.text import py_strip
    idx = global_index(pairs.withColumns({c: py_strip(F.coalesce(c, F.lit(""))) for c in (query_col, document_col)}),
                       list(order), "_i")
    some = idx.filter((F.col(query_col) != "") & (F.col(document_col) != ""))
    some = some.select(F.concat(F.lit("q"), F.col("_i").cast("string")).alias("qid"),
                       F.concat(F.lit("d"), F.col("_i").cast("string")).alias("did"),
                       F.col(query_col).alias("_q"), F.col(document_col).alias("_d"))
    return (some.select("qid", F.col("_q").alias("text")), some.select("did", F.col("_d").alias("text")),
            some.select("qid", "did"))
