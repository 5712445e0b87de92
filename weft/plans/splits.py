"""Registered split-construction queries.

On ``embeddings``: category = SHA-256 bucket (4) of vec_id, cluster = label
(the given cluster column of J1); the held-out cluster of each category is
the test split. On ``documents`` the grouped split search uses the
hash of the whole normalized text as the group and (lang, source) as dimensions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions.hashing import hex64_mod
from weft.functions.text import clean_text
from weft.operators import splits as J
from weft.operators.embed import hashed_embedding
from weft.operators.ordering import global_index
from weft.plans import sqlfrag as S
from weft.plans.audit import KEY_SQL, query_key
from weft.plans.vectors import _cos
from weft.session import cut_lineage, table

QUERIES: dict = {}
ORACLE: dict = {}

N_PERM = 2000


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.withColumn("cat", hex64_mod(F.sha2(F.col("vec_id").cast("string"), 256), 4))


_EMB_SQL = """emb AS (SELECT vec_id, label, embedding,
                      CAST(('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16))::UBIGINT % 4 AS BIGINT) AS cat FROM embeddings)"""
_CENT_SQL = _EMB_SQL + """,
ex AS (SELECT cat, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM emb),
cm AS (SELECT cat, label, pos, avg(x) AS m FROM ex GROUP BY ALL),
mv AS (SELECT cat, label, list(m ORDER BY pos) AS v FROM cm GROUP BY cat, label),
cent AS (SELECT cat, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM mv),
sizes AS (SELECT cat, label, count(*) AS rows FROM emb GROUP BY ALL),
summary AS (SELECT s.cat, s.label, s.rows, s.rows / sum(s.rows) OVER (PARTITION BY s.cat) AS share,
                   (SELECT 1 - max(""" + _cos("a.c", "b.c") + """) FROM cent a, cent b
                    WHERE a.cat = s.cat AND a.label = s.label AND b.cat = s.cat AND b.label <> s.label) AS isolation
            FROM sizes s),
flagged AS (SELECT *, CASE WHEN share >= 0.1 AND share <= 0.3 THEN 1 ELSE 0 END AS e,
                   abs(share - 0.2) AS dev FROM summary),
flagged2 AS (SELECT *, max(e) OVER (PARTITION BY cat) AS has FROM flagged),
holdout AS (SELECT cat, label, rows, share, isolation FROM (
    SELECT *, row_number() OVER (PARTITION BY cat ORDER BY e DESC,
        CASE WHEN has = 1 THEN -isolation ELSE dev END, CASE WHEN has = 1 THEN dev ELSE -isolation END, label) AS rk
    FROM flagged2) WHERE rk = 1)"""


def _summary(spark, sf):
    return J.cluster_summary(_emb(spark, sf), "cat", "label", "embedding")


def cluster_summary(spark, sf):
    """Rows, share and isolation per (category, label cluster)."""
    s = _summary(spark, sf)
    return s.select("cat", "label", "rows", F.round("share", 6).alias("share"),
                    F.round("isolation", 6).alias("isolation"))


QUERIES["cluster_summary"] = cluster_summary
ORACLE["cluster_summary"] = f"""
WITH {_CENT_SQL}
SELECT cat, label, rows, round(share, 6) AS share, round(isolation, 6) AS isolation FROM summary
"""


def _holdout(spark, sf):
    return J.cluster_holdout(_summary(spark, sf), "cat", "label")


def cluster_holdout(spark, sf):
    """The held-out cluster of every category."""
    h = _holdout(spark, sf)
    return h.select("cat", "label", "rows", F.round("share", 6).alias("share"),
                    F.round("isolation", 6).alias("isolation"))


QUERIES["cluster_holdout"] = cluster_holdout
ORACLE["cluster_holdout"] = f"""
WITH {_CENT_SQL}
SELECT cat, label, rows, round(share, 6) AS share, round(isolation, 6) AS isolation FROM holdout
"""


def marginals(spark, sf):
    """Value shares of lang and source over the documents."""
    m = J.marginals(table(spark, sf, "documents"), ["lang", "source"])
    return m.withColumn("p", F.round("p", 6))


QUERIES["marginals"] = marginals
ORACLE["marginals"] = """
WITH u AS (SELECT 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT dimension, value, round(count(*) / sum(count(*)) OVER (PARTITION BY dimension), 6) AS p FROM u GROUP BY dimension, value
"""


def total_variation(spark, sf):
    """TV between labelled and unlabelled documents' marginals."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id")
    a = J.marginals(d.join(lab, "doc_id", "left_semi"), ["lang", "source"])
    b = J.marginals(d.join(lab, "doc_id", "left_anti"), ["lang", "source"])
    return J.total_variation(a, b).withColumn("tv", F.round("tv", 6))


QUERIES["total_variation"] = total_variation
ORACLE["total_variation"] = """
WITH d AS (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS lab FROM documents),
u AS (SELECT lab, 'lang' AS dimension, lang AS value FROM d UNION ALL SELECT lab, 'source', source FROM d),
m AS (SELECT lab, dimension, value, count(*) / sum(count(*)) OVER (PARTITION BY lab, dimension) AS p FROM u GROUP BY lab, dimension, value),
a AS (SELECT * FROM m WHERE lab), b AS (SELECT * FROM m WHERE NOT lab)
SELECT coalesce(a.dimension, b.dimension) AS dimension, round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 6) AS tv
FROM a FULL OUTER JOIN b ON a.dimension = b.dimension AND a.value = b.value GROUP BY 1
"""


def _grouped_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", "source", query_key(clean_text("text")).alias("grp"))


def grouped_split_search(spark, sf):
    """200 seeded group splits of the documents toward a 10 % valid set."""
    d = _grouped_docs(spark, sf)
    n = d.count()
    target = round(0.10 * n)
    best = J.grouped_split_search(d, "grp", ["lang", "source"], target, n, seeds=200)
    return best.select(F.col("seed").cast("bigint").alias("seed"), "valid_rows", "size_error",
                       F.round("score", 6).alias("score"))


QUERIES["grouped_split_search"] = grouped_split_search
_GRP_SQL = KEY_SQL.replace("lower(query)", f"lower({S.clean('text')})")
ORACLE["grouped_split_search"] = f"""
WITH d AS (SELECT doc_id, lang, source, {_GRP_SQL} AS grp FROM documents),
k AS (SELECT count(*) AS n, CAST(round(0.10 * count(*)) AS BIGINT) AS target, count(DISTINCT grp) AS g FROM d),
nv AS (SELECT CAST(ceil((target / n) * g) AS BIGINT) AS nv FROM k),
gc AS (SELECT grp, count(*) AS rows FROM d GROUP BY grp),
sg AS (SELECT seed, grp, rows, row_number() OVER (PARTITION BY seed ORDER BY sha256(CAST(seed AS VARCHAR) || ':' || grp)) AS r
       FROM gc, (SELECT unnest(range(0, 200)) AS seed)),
ch AS (SELECT seed, grp, rows FROM sg WHERE r <= (SELECT nv FROM nv)),
size AS (SELECT seed, sum(rows) AS valid_rows FROM ch GROUP BY seed),
u AS (SELECT grp, 'lang' AS dimension, lang AS value FROM d UNION ALL SELECT grp, 'source', source FROM d),
whole AS (SELECT dimension, value, count(*) / sum(count(*)) OVER (PARTITION BY dimension) AS p FROM u GROUP BY dimension, value),
cand AS (SELECT ch.seed, dimension, value, count(*) / any_value(size.valid_rows) AS p
         FROM ch JOIN u USING (grp) JOIN size USING (seed) GROUP BY ch.seed, dimension, value),
grid AS (SELECT seed, w.* FROM whole w, (SELECT unnest(range(0, 200)) AS seed)),
tv AS (SELECT g.seed, 0.5 * sum(abs(coalesce(c.p, 0) - g.p)) AS tv FROM grid g
       LEFT JOIN cand c ON c.seed = g.seed AND c.dimension = g.dimension AND c.value = g.value GROUP BY g.seed),
sc AS (SELECT s.seed, s.valid_rows, abs(s.valid_rows - k.target) AS size_error,
              abs(s.valid_rows - k.target) / k.n + t.tv AS score FROM size s JOIN tv t USING (seed), k)
SELECT seed, CAST(valid_rows AS BIGINT) AS valid_rows, CAST(size_error AS BIGINT) AS size_error, round(score, 6) AS score
FROM sc ORDER BY score, size_error, seed LIMIT 1
"""


def _assigned(spark, sf):
    e = _emb(spark, sf)
    h = _holdout(spark, sf).select("cat", "label", F.lit(True).alias("_test"))
    e = e.join(h, ["cat", "label"], "left").withColumn("_test", F.coalesce("_test", F.lit(False)))
    n = e.count()
    target = round(0.10 * n)
    rest = e.filter(~F.col("_test")).withColumn("_h", J._hash_unit(F.lit("0"), F.col("vec_id").cast("string")))
    valid = global_index(rest, ["_h"], "_r").filter(F.col("_r") < target).select("vec_id", F.lit(True).alias("_valid"))
    out = e.join(valid, "vec_id", "left").withColumn("_valid", F.coalesce("_valid", F.lit(False)))
    return out.withColumn("split", J.assign_split(out, F.col("_test"), F.col("_valid"))), target


def assign_split(spark, sf):
    """test = held-out clusters, valid = 10 % of the rest by seeded hash, else train."""
    out, _ = _assigned(spark, sf)
    return out.select("vec_id", "split")


QUERIES["assign_split"] = assign_split
_ASSIGN_SQL = _CENT_SQL + """,
t AS (SELECT e.*, h.label IS NOT NULL AS test FROM emb e LEFT JOIN holdout h USING (cat, label)),
r AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('0:' || CAST(vec_id AS VARCHAR))) - 1 AS r FROM t WHERE NOT test),
assigned AS (SELECT t.vec_id, t.cat, t.label, CASE WHEN test THEN 'test'
                  WHEN r.r < (SELECT CAST(round(0.10 * count(*)) AS BIGINT) FROM emb) THEN 'valid' ELSE 'train' END AS split
             FROM t LEFT JOIN r USING (vec_id))"""
ORACLE["assign_split"] = f"WITH {_ASSIGN_SQL} SELECT vec_id, split FROM assigned"


def split_invariants(spark, sf):
    """Violations of a damaged J6 split, in which the test rows of category 0
    went to train: counts, the category missing from test, held-out rows in train. Expected counts come from the sizes
    of the held-out clusters."""
    out, target = _assigned(spark, sf)
    held = _holdout(spark, sf).agg(F.sum("rows").cast("bigint").alias("h")).first()["h"]
    n = out.count()
    expected = spark.createDataFrame(
        [("test", held), ("valid", target), ("train", n - held - target)], "split string, expected bigint")
    moved = (F.col("cat") == 0) & (F.col("split") == "test")
    damaged = out.withColumn("split", F.when(moved, "train").otherwise(F.col("split")))
    bad = J.split_invariants(damaged, "split", ["cat"], expected, F.col("_test"), F.col("_test"))
    return bad.groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


QUERIES["split_invariants"] = split_invariants
ORACLE["split_invariants"] = f"""
WITH {_ASSIGN_SQL},
m AS (SELECT count(*) AS m FROM assigned WHERE split = 'test' AND cat = 0)
SELECT "check", detail, CAST(n AS BIGINT) AS n FROM (
  SELECT 'split_count' AS "check", unnest(['test', 'train']) AS detail, 1 AS n FROM m WHERE m > 0
  UNION ALL SELECT 'missing_cat', 'test=0', 1 FROM m WHERE m > 0
  UNION ALL SELECT 'holdout_outside_test', 'train', m FROM m WHERE m > 0)
"""


def permutation_test(spark, sf):
    """Held-out shift against 2,000 size-matched random hold-outs per category."""
    e = _emb(spark, sf)
    h = _holdout(spark, sf).select("cat", "label", F.lit(True).alias("held"))
    e = e.join(h, ["cat", "label"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    r = J.permutation_test(e, "cat", "vec_id", "embedding", "held", N_PERM, seed=0)
    return r.select(*[F.round(c, 6).alias(c) for c in ("observed_shift", "random_mean", "effect_ratio", "p_value")],
                    "permutations")


QUERIES["permutation_test"] = permutation_test
ORACLE["permutation_test"] = "WITH " + _CENT_SQL + f""",
t AS (SELECT e.vec_id, e.cat, CAST(e.embedding AS DOUBLE[]) AS v, h.label IS NOT NULL AS held
      FROM emb e LEFT JOIN holdout h USING (cat, label)),
tx AS (SELECT vec_id, cat, held, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM t),
tot AS (SELECT cat, pos, sum(x) AS tt FROM tx GROUP BY ALL),
m AS (SELECT cat, CAST(count_if(held) AS BIGINT) AS m FROM t GROUP BY cat),
obs_s AS (SELECT cat, pos, sum(x) AS s FROM tx WHERE held GROUP BY ALL),
obs AS (SELECT avg(d) AS observed FROM (
    SELECT o.cat, 1 - sum(s * (tt - s)) / (sqrt(sum(s * s)) * sqrt(sum((tt - s) * (tt - s)))) AS d
    FROM obs_s o JOIN tot USING (cat, pos) GROUP BY o.cat)),
pr AS (SELECT perm, t.cat, t.vec_id, row_number() OVER (PARTITION BY perm, t.cat
         ORDER BY sha256('0:' || CAST(perm AS VARCHAR) || ':' || CAST(t.vec_id AS VARCHAR))) AS rk
       FROM t, (SELECT unnest(range(0, {N_PERM})) AS perm)),
sel AS (SELECT pr.perm, pr.cat, pr.vec_id FROM pr JOIN m USING (cat) WHERE rk <= m.m),
ps AS (SELECT perm, sel.cat, pos, sum(x) AS s FROM sel JOIN tx USING (cat, vec_id) GROUP BY ALL),
pd AS (SELECT perm, ps.cat, 1 - sum(s * (tt - s)) / (sqrt(sum(s * s)) * sqrt(sum((tt - s) * (tt - s)))) AS d
       FROM ps JOIN tot USING (cat, pos) GROUP BY ALL),
per AS (SELECT perm, avg(d) AS shift FROM pd GROUP BY perm)
SELECT round(any_value(observed), 6) AS observed_shift, round(avg(shift), 6) AS random_mean,
       round(any_value(observed) / avg(shift), 6) AS effect_ratio,
       round((CAST(count_if(shift >= observed) AS BIGINT) + 1) / (count(*) + 1), 6) AS p_value, count(*) AS permutations
FROM per, obs
"""


def grouped_kmeans(spark, sf):
    """K-means (k=5, 20 restarts to convergence) of the documents' word vectors inside
    each language; copies of a text (equal query keys) are one group and share a cluster."""
    d = table(spark, sf, "documents").select("doc_id", "lang", clean_text("text").alias("text"))
    keys = cut_lineage(d.select("doc_id", "lang", query_key("text").alias("grp")))
    v = cut_lineage(hashed_embedding(d, "doc_id", "text", dim=32).join(keys, "doc_id"))
    labelled, _inertia = J.grouped_kmeans(v, "lang", "doc_id", "embedding", k=5, restarts=20, seed=0, group="grp")
    return labelled.select("doc_id", "lang", "grp", "cluster")


def lloyd_step(spark, sf):
    """H10, one round: clusters around the five least vec_ids of each category."""
    e = _emb(spark, sf).select("vec_id", "cat", "embedding")
    first = e.withColumn("cluster", F.row_number().over(Window.partitionBy("cat").orderBy("vec_id")) - 1).where("cluster < 5")
    step = J.lloyd_step(e, "cat", "embedding", first)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return step.select(F.col("_cat").alias("cat"), "cluster", "n", F.round("inertia", 6).alias("inertia"),
                       F.round(total, 6).alias("total"))


QUERIES["lloyd_step"] = lloyd_step
ORACLE["lloyd_step"] = f"""
WITH {_EMB_SQL},
v AS (SELECT vec_id, CAST(cat AS VARCHAR) AS cat, CAST(embedding AS DOUBLE[]) AS e FROM emb),
c AS (SELECT cat, CAST(row_number() OVER (PARTITION BY cat ORDER BY vec_id) - 1 AS INTEGER) AS cluster, e FROM v),
d AS (SELECT v.vec_id, v.cat, v.e, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
      FROM v JOIN c ON c.cat = v.cat WHERE c.cluster < 5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, cat ORDER BY d2, cluster) AS k FROM d) WHERE k = 1)
SELECT cat, cluster, count(*) AS n, round(sum(d2), 6) AS inertia, round(sum(list_sum(e)), 6) AS total FROM b GROUP BY cat, cluster
"""


QUERIES["grouped_kmeans"] = grouped_kmeans  # iterative: rows-only; tests check the invariants

