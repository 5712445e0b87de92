"""Retrieval evaluation on judgements, with values worked out by hand."""

import math

import pytest

from weft.operators import metrics as M
from weft.operators import retrieval as R


@pytest.fixture(scope="module")
def parts(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0]), ("q3", [1.0, 1.0])], "qid string, vec array<double>")
    d = spark.createDataFrame([("d1", [1.0, 0.1]), ("d2", [1.0, 0.5]), ("d3", [0.0, 1.0]), ("d4", [-1.0, 0.0])],
                              "did string, vec array<double>")
    # q1: d2 (second) and d4 (last); q2: d3 (first), judged twice; q3 has none; unknown ids are left out
    rels = spark.createDataFrame([("q1", "d2"), ("q1", "d4"), ("q2", "d3"), ("q2", "d3"), ("q9", "d1"), ("q1", "d9")],
                                 "qid string, did string")
    return q, d, rels


def test_metrics_by_hand(parts):
    got = {r["qid"]: r for r in R.retrieval_metrics(*parts).collect()}
    assert set(got) == {"q1", "q2"}
    one = got["q1"]
    assert one["recall@10"] == 1.0 and one["precision@10"] == 0.2 and one["mrr@10"] == 0.5
    assert one["map@100"] == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert one["ndcg@10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert got["q2"]["mrr@10"] == got["q2"]["map@100"] == 1.0
    mean = {r["metric"]: r["value"] for r in M.mean_metrics(R.retrieval_metrics(*parts)).collect()}
    assert mean["mrr@10"] == 0.75


def test_ranks_by_hand(parts):
    assert {r["qid"]: r["rank"] for r in R.retrieval_ranks(*parts).collect()} == {"q1": 2, "q2": 1}


def test_pairs_to_ir_keeps_numbers_of_all_pairs(spark):
    pairs = spark.createDataFrame([(1, " a ", "b"), (2, " ", "c"), (3, None, "d"), (4, "e", " f")], "o int, q string, d string")
    queries, corpus, qrels = R.pairs_to_ir(pairs, ["o"], "q", "d")
    assert sorted(map(tuple, queries.collect())) == [("q0", "a"), ("q3", "e")]
    assert sorted(map(tuple, corpus.collect())) == [("d0", "b"), ("d3", "f")]
    assert sorted(map(tuple, qrels.collect())) == [("q0", "d0"), ("q3", "d3")]
