"""Registered vector and retrieval-evaluation queries on ``embeddings``
(E8, H2-H9, H11, I2-I14).

Roles (no id subsets): every vector is a query against all other vectors;
relevant = same label. Triplets: anchor = every vector, positive = the next
vector of its label (by vec_id), negatives = the vectors 1..4 places after
it in SHA-256 order of vec_id (cyclic).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.hashing import hex64_mod
from weft.operators import ivf as IVF
from weft.operators import metrics as M
from weft.operators import splits as J
from weft.operators import vectors as V
from weft.operators.ordering import global_index
from weft.session import cut_lineage, table

QUERIES: dict = {}
ORACLE: dict = {}


def _vecs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id"), F.col("label"), F.col("embedding"))


def _q(e):
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"),
                    F.col("label").alias("lab"))


def _d(e):
    return e.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec"),
                    F.col("label").alias("lab"))


def _triplets(spark, sf, n_neg=4):
    e = _vecs(spark, sf)
    by_label = global_index(e, ["label", "vec_id"], "_i")
    nxt = by_label.select((F.col("_i") - 1).alias("_i"), F.col("label").alias("_pl"),
                          F.col("vec_id").alias("p_id"), F.col("embedding").alias("p"))
    trip = (by_label.join(nxt, "_i").filter(F.col("label") == F.col("_pl"))
            .select("vec_id", "label", F.col("embedding").alias("a"), "p_id", "p"))
    hashed = global_index(e.withColumn("_h", F.sha2(F.col("vec_id").cast("string"), 256)),
                          ["_h"], "_r").drop("_h")
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    hashed = hashed.crossJoin(F.broadcast(n))  # one-row table
    out = trip.join(hashed.select("vec_id", "_r", "_n"), "vec_id")
    for k in range(1, n_neg + 1):
        nb = hashed.select(F.col("_r").alias(f"_r{k}"), F.col("vec_id").alias(f"n{k}_id"),
                           F.col("embedding").alias(f"n{k}"), F.col("label").alias(f"n{k}_label"))
        out = out.join(nb, F.pmod(F.col("_r") + k, F.col("_n")) == F.col(f"_r{k}")).drop(f"_r{k}")
    return out.drop("_r", "_n")


# ------------------------------------------------------------ SQL fixtures

VN_SQL = """vn AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
                  sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
           FROM embeddings)"""
PAIRS_SQL = VN_SQL + """,
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS did, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel,
                 CASE WHEN a.nrm * b.nrm > 0 THEN list_dot_product(a.e, b.e) / (a.nrm * b.nrm) ELSE 0 END AS score
          FROM vn a JOIN vn b ON a.vec_id <> b.vec_id)"""


def _cos(a, b):
    return (f"(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
            f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))))")


TRIP_SQL = """bl AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY label, vec_id) - 1 AS i FROM embeddings),
trip0 AS (SELECT a.vec_id, a.label, a.embedding AS a, b.vec_id AS p_id, b.embedding AS p
          FROM bl a JOIN bl b ON b.i = a.i + 1 AND b.label = a.label),
hs AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY sha256(CAST(vec_id AS VARCHAR))) - 1 AS r,
              count(*) OVER () AS n FROM embeddings),
trip AS (SELECT t.*, """ + ", ".join(
    f"h{k}.vec_id AS n{k}_id, h{k}.embedding AS n{k}, h{k}.label AS n{k}_label" for k in range(1, 5)) + """
         FROM trip0 t JOIN hs h0 ON h0.vec_id = t.vec_id """ + " ".join(
    f"JOIN hs h{k} ON h{k}.r = (h0.r + {k}) % h0.n" for k in range(1, 5)) + ")"


def ir_sql(pairs: str, group: str = "", k_top: int = 100) -> str:
    """Oracle for ir_per_query + mean_metrics over a pairs relation
    ([group,] qid, did, rel, score)."""
    g = f"{group}, " if group else ""
    gp = f"PARTITION BY {group}, qid" if group else "PARTITION BY qid"
    gb = f"GROUP BY {group}" if group else ""
    idcg = ("list_sum(list_transform(range(1, least(R, 10) + 1), lambda i: 1 / log2(i + 1)))")
    return f"""
ranked AS (SELECT * FROM (SELECT {g}qid, did, rel, row_number() OVER ({gp} ORDER BY score DESC, did) AS rank
                          FROM {pairs}) WHERE rank <= {k_top}),
cum AS (SELECT *, sum(rel) OVER ({gp} ORDER BY rank) AS c FROM ranked),
rc AS (SELECT {g}qid, CAST(sum(rel) AS BIGINT) AS R FROM {pairs} GROUP BY {g}qid),
pq AS (SELECT {g}qid,
          max(CASE WHEN rank <= 10 AND rel = 1 THEN 1.0 ELSE 0.0 END) AS acc10,
          sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10,
          sum(CASE WHEN rank <= 50 THEN rel ELSE 0 END) AS h50,
          max(CASE WHEN rank <= 10 AND rel = 1 THEN 1.0 / rank ELSE 0.0 END) AS mrr10,
          sum(CASE WHEN rank <= 10 AND rel = 1 THEN 1.0 / log2(rank + 1) ELSE 0.0 END) AS dcg10,
          sum(CASE WHEN rank <= 100 AND rel = 1 THEN c / rank ELSE 0.0 END) AS ap100
       FROM cum GROUP BY {g}qid),
per AS (SELECT {g}rc.qid, coalesce(acc10, 0) AS acc10, coalesce(h10, 0) / 10.0 AS p10,
               coalesce(h10, 0) / R AS r10, coalesce(h50, 0) / 50.0 AS p50, coalesce(h50, 0) / R AS r50,
               coalesce(mrr10, 0) AS mrr10, coalesce(dcg10, 0) / {idcg} AS ndcg10,
               coalesce(ap100, 0) / least(R, 100) AS map100
        FROM rc LEFT JOIN pq USING ({g}qid) WHERE R > 0),
mm AS (SELECT {g}avg(acc10) AS "accuracy@10", avg(p10) AS "precision@10", avg(r10) AS "recall@10",
              avg(p50) AS "precision@50", avg(r50) AS "recall@50", avg(mrr10) AS "mrr@10",
              avg(ndcg10) AS "ndcg@10", avg(map100) AS "map@100" FROM per {gb}),
ir_raw AS (SELECT {g}metric, value FROM (UNPIVOT mm ON "accuracy@10", "precision@10",
       "recall@10", "precision@50", "recall@50", "mrr@10", "ndcg@10", "map@100" INTO NAME metric VALUE value)),
ir AS (SELECT {g}metric, round(value, 6) AS value FROM ir_raw)
"""


# ------------------------------------------------------------ queries

def score_pairs(spark, sf):
    """The 10 best-scoring other vectors per vector (ties by id)."""
    e = _vecs(spark, sf)
    top = V.top_k(_q(e), _d(e), 10, exclude_self=True)
    return top.select("qid", "did", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


QUERIES["score_pairs"] = score_pairs
ORACLE["score_pairs"] = f"""
WITH {PAIRS_SQL}
SELECT qid, did, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM pairs) WHERE rank <= 10
"""


def knn(spark, sf):
    """H9: 5 nearest items by item, with label agreement."""
    e = _vecs(spark, sf)
    top = V.top_k(_q(e), _d(e), 5, exclude_self=True)
    lab = e.select(F.col("vec_id").alias("did"), F.col("label").alias("_dl"))
    qlab = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("_ql"))
    return (top.join(lab, "did").join(qlab, "qid")
            .select(F.col("qid").alias("item"), F.col("did").alias("neighbor"),
                    F.col("rank").cast("bigint").alias("rank"),
                    (F.col("_dl") == F.col("_ql")).alias("same_label")))


QUERIES["knn"] = knn
ORACLE["knn"] = f"""
WITH {PAIRS_SQL}
SELECT qid AS item, did AS neighbor, rank, rel = 1 AS same_label FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM pairs) WHERE rank <= 5
"""


def _ir(e, group=()):
    top = V.top_k(_q(e) if not group else e.select(*group, F.col("vec_id").alias("qid"),
                                                   F.col("embedding").alias("vec"), F.col("label").alias("lab")),
                  _d(e) if not group else e.select(*group, F.col("vec_id").alias("did"),
                                                   F.col("embedding").alias("vec"), F.col("label").alias("lab")),
                  100, group=group, exclude_self=True)
    dl = e.select(*group, F.col("vec_id").alias("did"), F.col("label").alias("_dl"))
    ql = e.select(*group, F.col("vec_id").alias("qid"), F.col("label").alias("_ql"))
    ranked = (top.join(dl, [*group, "did"]).join(ql, [*group, "qid"])
              .withColumn("rel", (F.col("_dl") == F.col("_ql")).cast("int")))
    sizes = e.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("_s"))
    rc = (e.join(sizes, [*group, "label"])
          .select(*group, F.col("vec_id").alias("qid"), (F.col("_s") - 1).alias("R")))
    return M.ir_per_query(ranked, rc, group)


def ir_metrics(spark, sf):
    """accuracy@10, precision/recall@10,50, MRR@10, NDCG@10, MAP@100."""
    return M.mean_metrics(_ir(_vecs(spark, sf)))


QUERIES["ir_metrics"] = ir_metrics
ORACLE["ir_metrics"] = f"WITH {PAIRS_SQL}, {ir_sql('pairs')} SELECT * FROM ir"


def _global_ranks(spark, sf):
    e = _vecs(spark, sf)
    return V.global_rank(_q(e), _d(e), exclude_self=True)


GR_SQL = PAIRS_SQL + """,
best AS (SELECT qid, max(score) AS b FROM pairs WHERE rel = 1 GROUP BY qid),
gr AS (SELECT p.qid, 1 + CAST(count_if(p.score > best.b) AS BIGINT) AS rank FROM pairs p JOIN best USING (qid) GROUP BY p.qid)"""


def global_rank(spark, sf):
    """I4: rank of the best relevant vector among all others."""
    return _global_ranks(spark, sf).select("qid", F.col("rank").cast("bigint"))


QUERIES["global_rank"] = global_rank
ORACLE["global_rank"] = f"WITH {GR_SQL} SELECT qid, CAST(rank AS BIGINT) AS rank FROM gr"

def global_rank_pruned(spark, sf):
    """I4 by the inverted file: the best relevant vector is sought within its label, and only
    blocks that the triangle inequality leaves open are multiplied."""
    e = _vecs(spark, sf)
    with_label = [F.col("label").alias("lab"), F.col("embedding").alias("vec")]
    best = V.top_k(e.select(F.col("vec_id").alias("qid"), *with_label), e.select(F.col("vec_id").alias("did"), *with_label),
                   1, ["lab"], exclude_self=True)
    best = best.select("qid", F.col("score").alias("best_relevant"))
    return IVF.global_rank(IVF.Index(_d(e)), _q(e), best, exclude_self=True).select("qid", F.col("rank").cast("bigint"))


QUERIES["global_rank_pruned"] = global_rank_pruned
ORACLE["global_rank_pruned"] = ORACLE["global_rank"]


def knn_recall(spark, sf):
    """H9, approximate: the share of the exact 5 nearest that the probed cells hold, for the
    queries with an id divisible by 100; probes calibrated on at most 1,000 other queries."""
    e = _vecs(spark, sf)
    queries, corpus = _q(e), _d(e)
    index = IVF.Index(corpus)
    sample = queries.where("qid % 100 <> 0").orderBy(F.xxhash64("qid")).limit(1000)
    probes, _ = IVF.calibrate(index, sample, corpus, 5, recall=0.97, exclude_self=True)
    asked = queries.where("qid % 100 = 0")
    near = IVF.knn(index, asked, 5, probes, exclude_self=True).select("qid", "did")
    exact = V.top_k(asked, corpus, 5, exclude_self=True).select("qid", "did")
    found = exact.join(near.withColumn("hit", F.lit(1)), ["qid", "did"], "left")
    return found.agg(F.countDistinct("qid").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
                     (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))


QUERIES["knn_recall"] = knn_recall
ORACLE["knn_recall"] = f"""
WITH {PAIRS_SQL},
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM pairs WHERE qid % 100 = 0)
SELECT count(DISTINCT qid) AS queries, count(*) AS neighbours, true AS reached FROM r WHERE rank <= 5
"""

_RM_SQL = """count(*) AS rows, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS "recall@1",
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS "recall@5",
  round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS "recall@10",
  round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS "mrr@10",
  round(median(rank), 6) AS median_rank"""


def rank_metrics(spark, sf):
    """recall@1/5/10, MRR@10 and median of the global ranks."""
    return M.rank_metrics(_global_ranks(spark, sf))


QUERIES["rank_metrics"] = rank_metrics
ORACLE["rank_metrics"] = f"WITH {GR_SQL} SELECT {_RM_SQL} FROM gr"


def rank_metrics_by(spark, sf):
    """I5 per label."""
    e = _vecs(spark, sf)
    ranks = _global_ranks(spark, sf).join(e.select(F.col("vec_id").alias("qid"), "label"), "qid")
    return M.rank_metrics(ranks, ["label"])


QUERIES["rank_metrics_by"] = rank_metrics_by
ORACLE["rank_metrics_by"] = (f"WITH {GR_SQL} SELECT label, {_RM_SQL} FROM gr "
                             "JOIN embeddings ON embeddings.vec_id = gr.qid GROUP BY label")


def check_vectors(spark, sf):
    return V.check_vectors(table(spark, sf, "embeddings"), "embedding", 64)


QUERIES["check_vectors"] = check_vectors
ORACLE["check_vectors"] = """
SELECT count(*) AS rows, CAST(count_if(embedding IS NULL) AS BIGINT) AS null_vectors, CAST(count_if(len(embedding) <> 64) AS BIGINT) AS wrong_dim,
       count(DISTINCT len(embedding)) AS distinct_dims, CAST(count_if(len(embedding) <= 0) AS BIGINT) AS empty_vectors FROM embeddings
"""


def _round_vec(c):
    return F.transform(c, lambda x: F.round(x, 6))


def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", _round_vec(V.l2_normalize("embedding")).alias("unit"))


QUERIES["l2_normalize"] = l2_normalize
ORACLE["l2_normalize"] = f"""
WITH {VN_SQL}
SELECT vec_id, CASE WHEN nrm > 0 THEN list_transform(e, lambda x: round(x / nrm, 6))
                    ELSE list_transform(e, lambda x: round(x, 6)) END AS unit FROM vn
"""


def pairwise_cosine(spark, sf):
    """H4: row-aligned cosine of anchor/positive and anchor/first negative."""
    t = _triplets(spark, sf)
    return t.select("vec_id", F.round(V.cosine("a", "p"), 6).alias("cos_ap"),
                    F.round(V.cosine("a", "n1"), 6).alias("cos_an"))


QUERIES["pairwise_cosine"] = pairwise_cosine
ORACLE["pairwise_cosine"] = f"""
WITH {TRIP_SQL}
SELECT vec_id, round({_cos('a', 'p')}, 6) AS cos_ap, round({_cos('a', 'n1')}, 6) AS cos_an FROM trip
"""


def hard_examples(spark, sf):
    """H5: positive below the best of three negatives -> test; else train pool."""
    t = _triplets(spark, sf)
    qp = V.cosine("a", "p")
    qn = F.greatest(*[F.nanvl(V.cosine("a", f"n{k}"), F.lit(None).cast("double")) for k in (1, 2, 3)])
    return t.select("vec_id", F.round(qp, 6).alias("qp"), F.round(qn, 6).alias("qnmax"),
                    F.when(qp < qn, "test").otherwise("train").alias("split"))


QUERIES["hard_examples"] = hard_examples
ORACLE["hard_examples"] = f"""
WITH {TRIP_SQL},
s AS (SELECT vec_id, {_cos('a', 'p')} AS qp, greatest({_cos('a', 'n1')}, {_cos('a', 'n2')}, {_cos('a', 'n3')}) AS qn FROM trip)
SELECT vec_id, round(qp, 6) AS qp, round(qn, 6) AS qnmax, CASE WHEN qp < qn THEN 'test' ELSE 'train' END AS split FROM s
"""


def concat_normalize(spark, sf):
    """H6: normalized (anchor ++ positive)."""
    t = _triplets(spark, sf)
    return t.select("vec_id", _round_vec(V.concat_normalize("a", "p")).alias("pair_vec"))


QUERIES["concat_normalize"] = concat_normalize
ORACLE["concat_normalize"] = f"""
WITH {TRIP_SQL},
c AS (SELECT vec_id, list_concat(CAST(a AS DOUBLE[]), CAST(p AS DOUBLE[])) AS v FROM trip),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nrm FROM c)
SELECT vec_id, list_transform(v, lambda x: round(x / nrm, 6)) AS pair_vec FROM n
"""


def mean_vector(spark, sf):
    """H7: per-label mean vector, normalized."""
    m = V.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    return m.select("label", _round_vec(F.col("mean")).alias("mean"))


_MEAN_SQL = """ex AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
                      unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings),
cm AS (SELECT label, pos, avg(x) AS m FROM ex GROUP BY label, pos),
mv AS (SELECT label, list(m ORDER BY pos) AS v FROM cm GROUP BY label),
mn AS (SELECT label, v, sqrt(list_dot_product(v, v)) AS nrm FROM mv),
cent AS (SELECT label, list_transform(v, lambda x: x / nrm) AS c FROM mn)"""
QUERIES["mean_vector"] = mean_vector
ORACLE["mean_vector"] = f"""
WITH {_MEAN_SQL}
SELECT label, list_transform(c, lambda x: round(x, 6)) AS mean FROM cent
"""


def centroid_isolation(spark, sf):
    """H8: 1 - max cosine of a label centroid to any other label centroid.

    Centroids meet in blocks, so labels may be many."""
    m = V.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    return J.isolation(m, [], "label").withColumn("isolation", F.round("isolation", 6))


QUERIES["centroid_isolation"] = centroid_isolation
ORACLE["centroid_isolation"] = f"""
WITH {_MEAN_SQL}
SELECT a.label, round(1 - max(list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c)))), 6) AS isolation
FROM cent a JOIN cent b ON a.label <> b.label GROUP BY a.label
"""


def mean_shift(spark, sf):
    """Cosine distance between the mean vectors of the two hash splits."""
    e = table(spark, sf, "embeddings").withColumn(
        "part", F.when(hex64_mod(F.sha2(F.col("vec_id").cast("string"), 256), 100) < 20, "held")
        .otherwise("rest"))
    m = V.mean_vector(e, ["part"], "embedding", normalize=False)
    a = m.filter(F.col("part") == "held").select(F.col("mean").alias("ma"))
    b = m.filter(F.col("part") == "rest").select(F.col("mean").alias("mb"))
    return a.crossJoin(b).select(F.round(1 - V.cosine("ma", "mb"), 6).alias("shift"))  # 1 x 1 rows


QUERIES["mean_shift"] = mean_shift
ORACLE["mean_shift"] = """
WITH p AS (SELECT CASE WHEN ('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16))::UBIGINT % 100 < 20
                       THEN 'held' ELSE 'rest' END AS part, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ex AS (SELECT part, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS pos FROM p),
cm AS (SELECT part, pos, avg(x) AS m FROM ex GROUP BY part, pos),
mv AS (SELECT part, list(m ORDER BY pos) AS v FROM cm GROUP BY part),
a AS (SELECT v FROM mv WHERE part = 'held'), b AS (SELECT v FROM mv WHERE part = 'rest')
SELECT round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS shift FROM a, b
"""


def local_rank(spark, sf):
    """Rank of the positive among its 4 candidates (positive + 3 negatives);
    rows with a repeated candidate are skipped."""
    t = _triplets(spark, sf)
    t = t.filter(F.size(F.array_distinct(F.array("p_id", "n1_id", "n2_id", "n3_id"))) == 4)
    scores = F.array(V.cosine("a", "p"), *[V.cosine("a", f"n{k}") for k in (1, 2, 3)])
    r = t.select(scores.alias("s")).select(
        M.local_rank(F.col("s")).alias("rank"),
        (F.element_at("s", 1) - F.array_max(F.slice("s", 2, 3))).alias("margin"))
    summary = M.local_rank_summary(r)
    hist = r.groupBy().pivot("rank", [1, 2, 3, 4]).count().na.fill(0)
    return summary.crossJoin(hist.select(*[F.col(str(i)).cast("bigint").alias(f"rank{i}")
                                           for i in (1, 2, 3, 4)]))  # 1 x 1 rows


QUERIES["local_rank"] = local_rank
ORACLE["local_rank"] = f"""
WITH {TRIP_SQL},
s AS (SELECT {_cos('a', 'p')} AS sp, {_cos('a', 'n1')} AS s1, {_cos('a', 'n2')} AS s2, {_cos('a', 'n3')} AS s3
      FROM trip WHERE len(list_distinct([p_id, n1_id, n2_id, n3_id])) = 4),
r AS (SELECT 1 + (s1 > sp)::INT + (s2 > sp)::INT + (s3 > sp)::INT AS rank, sp - greatest(s1, s2, s3) AS margin FROM s)
SELECT count(*) AS rows, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy,
       round(avg(1.0 / rank), 6) AS mrr, round(avg(margin), 6) AS mean_margin,
       round(avg(CASE WHEN margin <= 0 THEN 1.0 ELSE 0 END), 6) AS share_margin_le_0,
       CAST(count_if(rank = 1) AS BIGINT) AS rank1, CAST(count_if(rank = 2) AS BIGINT) AS rank2, CAST(count_if(rank = 3) AS BIGINT) AS rank3,
       CAST(count_if(rank = 4) AS BIGINT) AS rank4 FROM r
"""


def translation_accuracy(spark, sf):
    """Pair i = (anchor, positive); the best target of source i must be
    target i, and back; both accuracies and their mean."""
    t = cut_lineage(_triplets(spark, sf).select("vec_id", "a", "p"))  # several passes read it
    src = t.select(F.col("vec_id").alias("qid"), F.col("a").alias("vec"))
    tgt = t.select(F.col("vec_id").alias("did"), F.col("p").alias("vec"))
    fwd = V.top_k(src, tgt, 1)
    bwd = V.top_k(tgt.withColumnRenamed("did", "qid"), src.withColumnRenamed("qid", "did"), 1)
    f = fwd.agg(F.avg((F.col("qid") == F.col("did")).cast("double")).alias("src2tgt"))
    b = bwd.agg(F.avg((F.col("qid") == F.col("did")).cast("double")).alias("tgt2src"))
    return f.crossJoin(b).select(F.round("src2tgt", 6).alias("src2tgt"), F.round("tgt2src", 6).alias("tgt2src"),
                                 F.round((F.col("src2tgt") + F.col("tgt2src")) / 2, 6).alias("mean"))


QUERIES["translation_accuracy"] = translation_accuracy
ORACLE["translation_accuracy"] = f"""
WITH {TRIP_SQL},
pp AS (SELECT x.vec_id AS i, y.vec_id AS j, {_cos('x.a', 'y.p')} AS s FROM trip x, trip y),
f AS (SELECT i, arg_max(j, struct_pack(s := s, neg := -j)) AS best FROM pp GROUP BY i),
b AS (SELECT j, arg_max(i, struct_pack(s := s, neg := -i)) AS best FROM pp GROUP BY j),
fa AS (SELECT avg(CASE WHEN best = i THEN 1.0 ELSE 0 END) AS v FROM f),
ba AS (SELECT avg(CASE WHEN best = j THEN 1.0 ELSE 0 END) AS v FROM b)
SELECT round(fa.v, 6) AS src2tgt, round(ba.v, 6) AS tgt2src, round((fa.v + ba.v) / 2, 6) AS mean FROM fa, ba
"""


def triplet_accuracy(spark, sf):
    """I8: cos(a,p) > cos(a,n) + 0.1, averaged."""
    t = _triplets(spark, sf)
    return t.agg(F.round(M.triplet_accuracy(V.cosine("a", "p"), V.cosine("a", "n1")), 6)
                 .alias("triplet_accuracy"))


QUERIES["triplet_accuracy"] = triplet_accuracy
ORACLE["triplet_accuracy"] = f"""
WITH {TRIP_SQL}
SELECT round(avg(CASE WHEN {_cos('a', 'p')} > {_cos('a', 'n1')} + 0.1 THEN 1.0 ELSE 0 END), 6) AS triplet_accuracy FROM trip
"""


def _scored_pairs(spark, sf):
    t = _triplets(spark, sf)
    pos = t.select(F.round(V.cosine("a", "p"), 12).alias("score"), F.lit(1.0).alias("gold"))
    neg = t.select(F.round(V.cosine("a", "n1"), 12).alias("score"),
                   F.when(F.col("label") == F.col("n1_label"), 1.0).otherwise(0.0).alias("gold"))
    return pos.unionByName(neg)


def similarity_correlation(spark, sf):
    """Pearson and Spearman of cosine against the gold score."""
    return M.spearman_pearson(_scored_pairs(spark, sf), "score", "gold")


QUERIES["similarity_correlation"] = similarity_correlation
ORACLE["similarity_correlation"] = f"""
WITH {TRIP_SQL},
sp AS (SELECT round({_cos('a', 'p')}, 12) AS score, 1.0 AS gold FROM trip
       UNION ALL SELECT round({_cos('a', 'n1')}, 12), CASE WHEN label = n1_label THEN 1.0 ELSE 0.0 END FROM trip),
rk AS (SELECT score, gold, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs,
              rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0 AS rg FROM sp)
SELECT round(corr(score, gold), 6) AS pearson, round(corr(rs, rg), 6) AS spearman FROM rk
"""


def rerank_metrics(spark, sf):
    """MAP, MRR@5, NDCG@5 of the positive against 4 negatives."""
    t = _triplets(spark, sf)
    cands = t.select(F.col("vec_id").alias("qid"), F.explode(F.array(
        F.struct(F.col("p_id").alias("did"), V.cosine("a", "p").alias("score"), F.lit(1).alias("rel")),
        *[F.struct(F.col(f"n{k}_id").alias("did"), V.cosine("a", f"n{k}").alias("score"),
                   F.lit(0).alias("rel")) for k in (1, 2, 3, 4)])).alias("c")).select("qid", "c.*")
    per = M.rerank_per_query(cands, 5)
    return per.agg(F.round(F.avg("map"), 6).alias("map"), F.round(F.avg("`mrr@5`"), 6).alias("mrr@5"),
                   F.round(F.avg("`ndcg@5`"), 6).alias("ndcg@5"))


QUERIES["rerank_metrics"] = rerank_metrics
_RR_SQL = f"""rr_c AS (SELECT vec_id AS qid, p_id AS did, {_cos('a', 'p')} AS score, 1 AS rel FROM trip
      """ + " ".join(f"UNION ALL SELECT vec_id, n{k}_id, {_cos('a', f'n{k}')}, 0 FROM trip" for k in (1, 2, 3, 4)) + """),
rr_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did, rel) AS rank FROM rr_c),
rr_r2 AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM rr_r),
rr_pq AS (SELECT qid, sum(CASE WHEN rel = 1 THEN cum / rank ELSE 0 END) / sum(rel) AS ap,
              max(CASE WHEN rel = 1 AND rank <= 5 THEN 1.0 / rank ELSE 0 END) AS mrr,
              sum(CASE WHEN rel = 1 AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM rr_r2 GROUP BY qid)"""
ORACLE["rerank_metrics"] = f"""
WITH {TRIP_SQL}, {_RR_SQL}
SELECT round(avg(ap), 6) AS map, round(avg(mrr), 6) AS "mrr@5", round(avg(dcg), 6) AS "ndcg@5" FROM rr_pq
"""


def composite_score(spark, sf):
    """Several evaluators' main scores, and their mean as 'sequential'."""
    tri = triplet_accuracy(spark, sf).select(F.lit("triplet").alias("evaluator"),
                                             F.lit("accuracy").alias("metric"),
                                             F.col("triplet_accuracy").alias("value"))
    rr = rerank_metrics(spark, sf).select(F.lit("rerank").alias("evaluator"), F.lit("map").alias("metric"),
                                          F.col("map").alias("value"))
    ir = ir_metrics(spark, sf).filter(F.col("metric") == "ndcg@10").select(
        F.lit("ir").alias("evaluator"), "metric", "value")
    parts = tri.unionByName(rr).unionByName(ir)
    main = parts.agg(F.lit("sequential").alias("evaluator"), F.lit("mean_main").alias("metric"),
                     F.round(F.avg("value"), 6).alias("value"))
    return parts.unionByName(main)


QUERIES["composite_score"] = composite_score
ORACLE["composite_score"] = f"""
WITH {TRIP_SQL}, {_RR_SQL}, {PAIRS_SQL}, {ir_sql('pairs')},
parts AS (SELECT 'triplet' AS evaluator, 'accuracy' AS metric,
                 round(avg(CASE WHEN {_cos('a', 'p')} > {_cos('a', 'n1')} + 0.1 THEN 1.0 ELSE 0 END), 6) AS value FROM trip
          UNION ALL SELECT 'rerank', 'map', round(avg(ap), 6) FROM rr_pq
          UNION ALL SELECT 'ir', metric, value FROM ir WHERE metric = 'ndcg@10')
SELECT * FROM parts UNION ALL SELECT 'sequential', 'mean_main', round(avg(value), 6) FROM parts
"""


def _with_dataset(spark, sf):
    e = _vecs(spark, sf)
    return e.withColumn("dataset", hex64_mod(F.sha2(F.col("vec_id").cast("string"), 256), 4))


def benchmark_mean(spark, sf):
    """I2 inside each of 4 hash datasets, plus the mean over datasets."""
    wide = M.mean_metrics(_ir(_with_dataset(spark, sf), ["dataset"]), ["dataset"], long=False)
    raw = wide.unpivot(["dataset"], [c for c in wide.columns if "@" in c], "metric", "value")
    mean = raw.groupBy("metric").agg(F.avg("value").alias("value")) \
        .withColumn("dataset", F.lit(-1).cast("bigint"))
    return raw.unionByName(mean).withColumn("value", F.round("value", 6))


QUERIES["benchmark_mean"] = benchmark_mean
_DS_PAIRS = VN_SQL + """,
vd AS (SELECT *, ('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16))::UBIGINT % 4 AS dataset FROM vn),
dpairs AS (SELECT a.dataset, a.vec_id AS qid, b.vec_id AS did, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel,
                  list_dot_product(a.e, b.e) / (a.nrm * b.nrm) AS score
           FROM vd a JOIN vd b ON a.dataset = b.dataset AND a.vec_id <> b.vec_id)"""
ORACLE["benchmark_mean"] = f"""
WITH {_DS_PAIRS}, {ir_sql('dpairs', 'dataset')}
SELECT CAST(dataset AS BIGINT) AS dataset, metric, value FROM ir
UNION ALL SELECT -1, metric, round(avg(value), 6) FROM ir_raw GROUP BY metric
"""


def _two_models(spark, sf):
    e = _vecs(spark, sf)
    full = e.withColumn("model", F.lit("full"))
    half = e.withColumn("embedding", F.slice("embedding", 1, 32)).withColumn("model", F.lit("half"))
    return full.unionByName(half)


def compare_models(spark, sf):
    """The I2 table of two models (full and first-32-dimension vectors) in one job."""
    return M.mean_metrics(_ir(_two_models(spark, sf), ["model"]), ["model"])


QUERIES["compare_models"] = compare_models
_MODEL_PAIRS = """vm AS (SELECT 'full' AS model, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
       UNION ALL SELECT 'half', vec_id, label, CAST(embedding[1:32] AS DOUBLE[]) FROM embeddings),
vmn AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM vm),
mpairs AS (SELECT a.model, a.vec_id AS qid, b.vec_id AS did, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel,
                  list_dot_product(a.e, b.e) / (a.nrm * b.nrm) AS score
           FROM vmn a JOIN vmn b ON a.model = b.model AND a.vec_id <> b.vec_id)"""
ORACLE["compare_models"] = f"WITH {_MODEL_PAIRS}, {ir_sql('mpairs', 'model')} SELECT * FROM ir"

MAIN_METRICS = ("ndcg@10", "mrr@10", "map@100")


def select_metrics(spark, sf):
    """The main metrics of every model, from the wide table melted to long."""
    wide = M.mean_metrics(_ir(_two_models(spark, sf), ["model"]), ["model"], long=False)
    long = wide.unpivot(["model"], [c for c in wide.columns if "@" in c], "metric", "value")
    return (long.filter(F.col("metric").isin(*MAIN_METRICS))
            .withColumn("value", F.round("value", 6)))


QUERIES["select_metrics"] = select_metrics
ORACLE["select_metrics"] = (f"WITH {_MODEL_PAIRS}, {ir_sql('mpairs', 'model')} SELECT * FROM ir "
                            f"WHERE metric IN {MAIN_METRICS}")


def embed_text(spark, sf):
    """H1: documents with the 'passage: ' prompt -> 64-d signed feature-hashing vectors."""
    from weft.operators.embed import hashed_embedding
    return hashed_embedding(table(spark, sf, "documents"), "doc_id", "text", 64, prompt="passage: ")


QUERIES["embed_text"] = embed_text
_WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ORACLE["embed_text"] = f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower('passage: ' || coalesce(text, '')), '{_WS}'),
                                             lambda x: x <> '')) AS w FROM documents),
h AS (SELECT doc_id, sha256(w) AS h FROM w),
s AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::UBIGINT % 64 AS INTEGER) AS b,
             CAST(sum(CASE WHEN ('0x' || substr(h, 9, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v
      FROM h GROUP BY doc_id, b),
p AS (SELECT doc_id, list(struct_pack(b := b, v := v)) AS pairs FROM s GROUP BY doc_id)
SELECT d.doc_id, list_transform(range(0, 64), lambda i: coalesce(list_filter(p.pairs, lambda q: q.b = i)[1].v, 0.0)) AS embedding
FROM documents d LEFT JOIN p USING (doc_id)
"""
