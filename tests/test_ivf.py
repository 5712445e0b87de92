"""Inverted file: blocks, approximate neighbours and ranks against plain products."""

import numpy as np
import pytest

from weft.operators import ivf


def table(spark, x, name):
    return spark.createDataFrame([(i, v.tolist() if v is not None else None) for i, v in enumerate(x)],
                                 f"{name} long, vec array<double>").repartition(3)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 8))
    x = np.concatenate([c + 0.15 * rng.standard_normal((60, 8)) for c in centers])
    x[5] = 0.0
    x[7] = x[6]
    return x


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def test_blocks_are_bounded_rings(spark, clustered):
    index = ivf.Index(table(spark, clustered, "did"), cells=10, block=25)
    rows = index.rows.collect()
    assert len(rows) == len(clustered) and index.blocks["n"].max() <= 25 and index.blocks["n"].sum() == len(rows)
    b = index.blocks.set_index("block")
    for r in rows:
        if any(r.vec):
            angle = np.arccos(np.clip(unit(np.array([r.vec]))[0] @ index.centroids[int(b.loc[r.block, "cell"])], -1, 1))
            assert b.loc[r.block, "lo"] - 1e-9 <= angle <= b.loc[r.block, "hi"] + 1e-9


def test_neighbours_reach_the_calibrated_recall(spark, clustered):
    corpus = table(spark, clustered, "did")
    queries = corpus.withColumnRenamed("did", "qid")
    index = ivf.Index(corpus, cells=12, block=50)
    probes, recall = ivf.calibrate(index, queries, corpus, 5, 0.95, exclude_self=True)
    assert recall >= 0.95 and probes < 12
    got = {}
    for r in ivf.knn(index, queries, 5, probes, exclude_self=True).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.did))
    u = unit(clustered)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -np.inf)
    truth = {i: set(np.lexsort((np.arange(len(u)), -s[i]))[:5]) for i in range(len(u))}
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert np.mean([len(truth[i] & {d for _, d in got.get(i, [])}) / 5 for i in truth]) >= 0.95
    full = {}
    for r in ivf.knn(index, queries, 5, 12, exclude_self=True).collect():
        full.setdefault(r.qid, set()).add(r.did)
    assert full == truth


@pytest.mark.parametrize("exclude_self", [False, True])
def test_counts_above_equal_plain_products_and_skip_blocks(spark, clustered, exclude_self):
    corpus = table(spark, clustered, "did")
    rng = np.random.default_rng(8)
    bars = [*rng.uniform(-1, 1, len(clustered) - 2), 0.0, 1.0]
    queries = spark.createDataFrame([(i, v.tolist(), float(b)) for (i, v), b in zip(enumerate(clustered), bars)],
                                    "qid long, vec array<double>, thr double").repartition(2)
    index = ivf.Index(corpus, cells=12, block=20)
    above, work = ivf.count_above(index, queries, exclude_self)
    u = unit(clustered)
    s = u @ u.T
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
    want = {i: int((s[i] > b + 1e-12).sum()) for i, b in enumerate(bars)}
    assert {r.qid: r.above for r in above.collect()} == want
    w = work.first()
    assert w["pairs"] == len(clustered) * len(index.blocks) and w["products"] < 0.7 * w["pairs"]


def test_empty_corpus_and_odd_vectors(spark):
    none = spark.createDataFrame([], "did long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    assert ivf.knn(ivf.Index(none), queries, 3, 2).collect() == []
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "did long, vec array<double>")
    got = [(r.did, r.score) for r in ivf.knn(ivf.Index(odd, cells=1), queries, 4, 1).collect()]
    assert sorted(got) == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]
