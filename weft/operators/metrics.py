"""Ranking and evaluation metrics (I1-I14) over tables.

Per-query values are computed from bounded groups (the top-k rows of one
query, or one row per query), then averaged; the public definitions:
accuracy@k, precision@k = hits/k, recall@k = hits/R, MRR@k, NDCG@k with
binary gains, AP@k = sum of precision@i at relevant i <= k over min(k, R).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ordering import null_safe_join
from weft.operators.quantiles import exact_quantiles
from weft.session import cut_lineage

D = 6  # output decimals


def _r(c: Column) -> Column:
    return F.round(c, D)


def idcg(r: Column, k: int) -> Column:
    """DCG of min(R, k) leading relevant hits."""
    m = F.least(r, F.lit(k))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0),
                       lambda acc, i: acc + F.when(i <= m, 1.0 / F.log2(i + 1)).otherwise(0.0))


def ir_per_query(ranked: DataFrame, relevant_counts: DataFrame, group: Sequence[str] = (),
                 acc_k=(10,), prec_k=(10, 50), ndcg_k=(10,), mrr_k=(10,), map_k=(100,)) -> DataFrame:
    """Per-query IR values from ranked hits (group.., qid, did, rank, rel) and
    relevant counts (group.., qid, R). Queries with R = 0 are skipped."""
    g = list(group)
    w = Window.partitionBy(*g, "qid").orderBy("rank")  # <= max k rows per query
    hits = ranked.withColumn("_cum", F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = []
    for k in acc_k:
        aggs.append(F.max(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1.0).otherwise(0.0))
                    .alias(f"accuracy@{k}"))
    for k in prec_k:
        aggs.append(F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"_hits{k}"))
    for k in mrr_k:
        aggs.append(F.max(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1.0 / F.col("rank"))
                          .otherwise(0.0)).alias(f"mrr@{k}"))
    for k in ndcg_k:
        aggs.append(F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1),
                                 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_dcg{k}"))
    for k in map_k:
        aggs.append(F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1),
                                 F.col("_cum") / F.col("rank")).otherwise(0.0)).alias(f"_ap{k}"))
    per = hits.groupBy(*g, "qid").agg(*aggs)
    per = relevant_counts.filter(F.col("R") > 0).join(per, [*g, "qid"], "left").na.fill(0.0)
    out = per
    for k in prec_k:
        out = (out.withColumn(f"precision@{k}", F.col(f"_hits{k}") / k)
                  .withColumn(f"recall@{k}", F.col(f"_hits{k}") / F.col("R")))
    for k in ndcg_k:
        out = out.withColumn(f"ndcg@{k}", F.col(f"_dcg{k}") / idcg(F.col("R"), k))
    for k in map_k:
        out = out.withColumn(f"map@{k}", F.col(f"_ap{k}") / F.least(F.col("R"), F.lit(k)))
    drop = [c for c in out.columns if c.startswith("_")]
    return out.drop(*drop)


def mean_metrics(per_query: DataFrame, group: Sequence[str] = (), long: bool = True) -> DataFrame:
    """Mean of every metric column over queries; long form (group.., metric, value)."""
    metric_cols = [c for c in per_query.columns if "@" in c]
    wide = per_query.groupBy(*group).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in metric_cols])
    if not long:
        return wide
    return (wide.unpivot(list(group), metric_cols, "metric", "value")
            .withColumn("value", _r(F.col("value"))))


def local_rank(scores: Column) -> Column:
    """1 + number of negatives scoring strictly above the positive
    (scores[0] is the positive)."""
    pos = F.element_at(scores, 1)
    return (F.size(F.filter(scores, lambda x, i: (i > 0) & (x > pos))) + 1).cast("bigint")


def local_rank_summary(df: DataFrame, rank_col: str = "rank", margin_col: str = "margin") -> DataFrame:
    """Rows, accuracy (rank 1), MRR, mean margin, share of margin <= 0."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  _r(F.avg((F.col(rank_col) == 1).cast("double"))).alias("accuracy"),
                  _r(F.avg(1.0 / F.col(rank_col))).alias("mrr"),
                  _r(F.avg(margin_col)).alias("mean_margin"),
                  _r(F.avg((F.col(margin_col) <= 0).cast("double"))).alias("share_margin_le_0"))


def rank_metrics(ranks: DataFrame, group: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """Rows, Recall@1/5/10, MRR@10, median rank (per group)."""
    r, g = F.col(rank_col), list(group)
    ranks = cut_lineage(ranks.select(*g, rank_col))  # several passes read it
    rest = ranks.groupBy(*g).agg(
        F.count(F.lit(1)).alias("rows"),
        *[_r(F.avg((r <= k).cast("double"))).alias(f"recall@{k}") for k in (1, 5, 10)],
        _r(F.avg(F.when(r <= 10, 1.0 / r).otherwise(0.0))).alias("mrr@10"))
    median = exact_quantiles(ranks, g, [rank_col], [0.5]).select(*g, _r(F.col(rank_col)[0]).alias("median_rank"))
    return null_safe_join(rest, median, g, "left") if g else rest.join(median, how="left")  # one row each


def triplet_accuracy(pos_score: Column, neg_score: Column, margin: float = 0.1) -> Column:
    """I8: share of triplets with cos(a,p) > cos(a,n) + margin (aggregate)."""
    return F.avg((pos_score > neg_score + margin).cast("double"))


def average_ranks(df: DataFrame, value: str, out_col: str) -> DataFrame:
    """Ranks with ties averaged (1-based), without a global window: for each
    distinct value, (#values below) + (ties + 1) / 2 from a prefix count over
    the distinct values (range-partitioned, see ``running_total``)."""
    from weft.operators.ordering import running_total
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_t"))
    cum = running_total(counts, [value], "_t", "_upto")
    ranks = cum.select(value, ((F.col("_upto") - F.col("_t")) + (F.col("_t") + 1) / 2.0).alias(out_col))
    return df.join(ranks, value)


def spearman_pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of (x, y) and Spearman = Pearson of average ranks."""
    rx = average_ranks(df, x, "_rx")
    rxy = average_ranks(rx, y, "_ry")
    return rxy.agg(_r(F.corr(x, y)).alias("pearson"), _r(F.corr("_rx", "_ry")).alias("spearman"))


def rerank_per_query(cands: DataFrame, at_k: int = 5) -> DataFrame:
    """Per query MAP, MRR@k, NDCG@k of candidates (qid, did, score, rel),
    ranked by score (ties by did, then non-relevant first). Candidate lists
    are small (1 + negatives)."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"), F.asc("rel"))
    r = cands.withColumn("rank", F.row_number().over(w))
    r = r.withColumn("_cum", F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = r.groupBy("qid").agg(
        F.sum("rel").alias("_R"),
        F.sum(F.when(F.col("rel") == 1, F.col("_cum") / F.col("rank")).otherwise(0.0)).alias("_ap"),
        F.max(F.when((F.col("rel") == 1) & (F.col("rank") <= at_k), 1.0 / F.col("rank"))
              .otherwise(0.0)).alias(f"mrr@{at_k}"),
        F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= at_k), 1.0 / F.log2(F.col("rank") + 1))
              .otherwise(0.0)).alias("_dcg"))
    per = per.filter(F.col("_R") > 0)
    return per.select("qid", (F.col("_ap") / F.col("_R")).alias("map"), f"`mrr@{at_k}`",
                      (F.col("_dcg") / idcg(F.col("_R"), at_k)).alias(f"ndcg@{at_k}"))
