"""Block-pair scoring against NumPy brute force; metrics against Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import metrics as M
from weft.operators import splits as J
from weft.operators import vectors as V
from weft.session import table

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def emb(spark):
    e = table(spark, SF_SMALL, "embeddings").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in e])
    lab = np.array([r["label"] for r in e])
    x = np.array([r["embedding"] for r in e], dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ids, lab, x


def _frames(spark):
    e = table(spark, SF_SMALL, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").alias("lab"))
    d = e.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec"), F.col("label").alias("lab"))
    return q, d


def test_top_k_matches_brute_force_with_many_blocks(spark, emb):
    ids, _, x = emb
    q, d = _frames(spark)
    got = V.top_k(q, d, 7, exclude_self=True, block_q=64, block_d=100).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    exp = {}
    for i, qi in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:7]
        exp[qi] = [ids[j] for j in order]
    res = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        res.setdefault(r["qid"], []).append(r["did"])
    assert res == exp


def test_global_rank_matches_brute_force(spark, emb):
    ids, lab, x = emb
    q, d = _frames(spark)
    got = {r["qid"]: r["rank"] for r in V.global_rank(q, d, exclude_self=True, block_q=100, block_d=128).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i, qi in enumerate(ids):
        rel = (lab == lab[i]) & (ids != qi)
        best = s[i][rel].max()
        assert got[qi] == 1 + int((s[i] > best).sum())


def test_global_rank_scores_the_best_relevant_once(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, vec array<double>, lab long")
    out = V.global_rank(df.withColumnRenamed("i", "qid"), df.withColumnRenamed("i", "did"), exclude_self=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the scores above the best


def py_ir(ranked_rel, R, k_acc=10):
    """Public definitions for one query: ranked_rel = 0/1 list by rank."""
    hits10 = sum(ranked_rel[:10])
    first = next((i + 1 for i, v in enumerate(ranked_rel[:10]) if v), None)
    dcg = sum(v / math.log2(i + 2) for i, v in enumerate(ranked_rel[:10]))
    idcg = sum(1 / math.log2(i + 2) for i in range(min(R, 10)))
    cum, ap = 0, 0.0
    for i, v in enumerate(ranked_rel[:100]):
        if v:
            cum += 1
            ap += cum / (i + 1)
    return {"accuracy@10": float(hits10 > 0), "precision@10": hits10 / 10, "recall@10": hits10 / R,
            "mrr@10": 1 / first if first else 0.0, "ndcg@10": dcg / idcg, "map@100": ap / min(R, 100)}


def test_ir_metrics_match_python(spark, emb):
    ids, lab, x = emb
    from weft.plans.vectors import _ir
    per = {r["qid"]: r for r in _ir(table(spark, SF_SMALL, "embeddings").select("vec_id", "label", "embedding"))
           .collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i in range(0, len(ids), 37):
        qi = ids[i]
        order = sorted([j for j in range(len(ids)) if j != i], key=lambda j: (-s[i, j], ids[j]))[:100]
        rel = [int(lab[j] == lab[i]) for j in order]
        R = int(((lab == lab[i]) & (ids != qi)).sum())
        exp = py_ir(rel, R)
        for k, v in exp.items():
            assert per[qi][k] == pytest.approx(v, abs=1e-12), k


def test_zero_vector_and_normalize(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "i int, v array<double>")
    out = df.select("i", V.l2_normalize("v").alias("u"), V.cosine("v", "v").alias("c")).orderBy("i").collect()
    assert out[0]["u"] == [0.0, 0.0] and out[0]["c"] == 0.0
    assert out[1]["u"] == pytest.approx([0.6, 0.8]) and out[1]["c"] == pytest.approx(1.0)


def test_check_vectors_flags_wrong_dims(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    r = V.check_vectors(df, "v", 2).first()
    assert (r["rows"], r["null_vectors"], r["wrong_dim"]) == (3, 1, 1)


def test_rank_metrics_definitions(spark):
    df = spark.createDataFrame([(1,), (3,), (6,), (20,)], "rank long")
    r = M.rank_metrics(df).first()
    assert r["recall@1"] == 0.25 and r["recall@5"] == 0.5 and r["recall@10"] == 0.75
    assert r["mrr@10"] == pytest.approx(round((1 + 1 / 3 + 1 / 6) / 4, 6))
    assert r["median_rank"] == 4.5


def test_spearman_with_ties(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 5.0, 4.0]
    ys = [1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    r = M.spearman_pearson(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "x", "y").first()

    def ranks(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        rk = [0.0] * len(v)
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
                j += 1
            for t in range(i, j + 1):
                rk[order[t]] = (i + j) / 2 + 1
            i = j + 1
        return rk
    assert r["spearman"] == pytest.approx(np.corrcoef(ranks(xs), ranks(ys))[0, 1], abs=1e-6)
    assert r["pearson"] == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-6)


def test_grouped_kmeans_on_planted_clusters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for cat in range(3):
        centers = rng.normal(size=(4, 8)) * 10
        for i in range(120):
            c = i % 4
            rows.append((cat, cat * 1000 + i, (centers[c] + rng.normal(size=8) * 0.1).tolist(), c))
    df = spark.createDataFrame(rows, "cat int, k long, v array<double>, truth int")
    out, inert = J.grouped_kmeans(df, "cat", "k", "v", k=4, restarts=3, iters=6)
    got = out.select("cat", "truth", "cluster").collect()
    for cat in range(3):
        pairs = {(r["truth"], r["cluster"]) for r in got if r["cat"] == cat}
        assert len(pairs) == 4  # clusters recovered one to one
    assert inert.count() == 9


def test_grouped_kmeans_converges_on_group_means(spark):
    """Rows of a group share a cluster, each group mean is nearest its cluster's mean, and the best of the starts is returned."""
    rng = np.random.default_rng(7)
    rows = [(c, int(g), (rng.normal(size=3) * 3 + np.array([g % 7, c, 1])).tolist())
            for c in range(2) for g in np.repeat(np.arange(150), 2)]
    df = spark.createDataFrame(rows, "cat int, g long, v array<double>")
    out, inert = J.grouped_kmeans(df, "cat", "g", "v", k=5, restarts=4, group="g")
    got = out.select("cat", "g", "v", "cluster").collect()
    assert len(got) == len(rows) and inert.count() == 8
    for c in range(2):
        own = [r for r in got if r["cat"] == c]
        label = dict({(r["g"], r["cluster"]) for r in own})
        assert len({(r["g"], r["cluster"]) for r in own}) == len(label) == 150
        x = np.array([np.mean([r["v"] for r in own if r["g"] == g], axis=0) for g in sorted(label)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lab = np.array([label[g] for g in sorted(label)])
        centres = np.array([x[lab == j].mean(axis=0) for j in range(5)])
        d2 = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (d2.argmin(axis=1) == lab).all()
        best = min(r["inertia"] for r in inert.collect() if r["cat"] == str(c))
        assert d2.min(axis=1).sum() == pytest.approx(best)


def test_split_invariants_report_violations(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "train"), (3, "a", "test"), (4, "c", "valid")],
                               "k long, d string, split string")
    exp = spark.createDataFrame([("train", 2), ("test", 2), ("valid", 1)], "split string, expected bigint")
    got = {tuple(r) for r in J.split_invariants(df, "split", ["d"], exp, F.col("k") != 3).collect()}
    assert got == {("missing_d", "test=b"), ("missing_d", "test=c"), ("missing_d", "train=c"),
                   ("missing_d", "valid=a"), ("missing_d", "valid=b"), ("split_count", "test"),
                   ("test_outside_holdout", "row")}


def test_block_pairs_move_rows_once_with_groups_nulls_and_ties(spark):
    rows = [(g, i, [float((i * 7 + j) % 5) for j in range(3)] if i % 11 else None, i % 3)
            for g in ("a", None) for i in range(70)]
    df = spark.createDataFrame(rows, "g string, i long, vec array<double>, lab long")
    q, d = df.withColumnRenamed("i", "qid"), df.withColumnRenamed("i", "did")
    out = V.block_pairs(q, d, "topk", 4, ["g"], True, block_q=16, block_d=9)
    assert "Generate" not in out._jdf.queryExecution().toString()  # rows were copied once per block of the other side
    got = {(r["g"], r["qid"], r["rank"]): (r["did"], r["score"]) for r in V.top_k(q, d, 4, ["g"], True, block_q=16, block_d=9).collect()}
    x = np.array([v or [0.0] * 3 for _, _, v, _ in rows[:70]])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    s = np.round(x @ x.T, 12)
    for i in range(70):
        order = [j for j in np.lexsort((np.arange(70), -s[i])).tolist() if j != i][:4]
        for g in ("a", None):
            found = [got[g, i, r] for r in range(1, 5)]
            assert len({j for j, _ in found} - {i}) == 4
            assert all(abs(v - s[i, j]) < 1e-9 and abs(v - s[i, o]) < 1e-9 for (j, v), o in zip(found, order))
    best = {(r["g"], r["qid"]): r["value"] for r in V.block_pairs(q, d, "best_relevant", 0, ["g"], True, 16, 9)
            .groupBy("g", "qid").agg(F.max("value").alias("value")).collect()}
    assert len(best) == 140
    assert all(abs(best[g, i] - max(s[i, j] for j in range(70) if j != i and j % 3 == i % 3)) < 1e-9
               for g in ("a", None) for i in range(70))
