"""Exact quantiles against numpy, and draws of one row by the hundred thousand."""

import math

import numpy as np
from pyspark.sql import functions as F


def test_quantiles_are_those_of_numpy(spark):
    from weft.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=5001).tolist(), "b": [7.0] * 50, "c": [1.0, 2.0], "d": [5.0], None: [3.0, 1.0, 2.0, 2.0],
              "e": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300], "f": rng.integers(0, 4, 1000).astype(float).tolist(),
              "g": (1.0 + np.arange(100) * 2.0 ** -52).tolist()}
    rows = [(g, v, None if i % 2 else v * 0.5) for g, x in groups.items() for i, v in enumerate(x)] + [("z", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["g"], ["v", "w"], probs).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        s = sorted(x)
        for col, x in (("v", s), ("w", sorted(v * 0.5 for i, v in enumerate(groups[g]) if i % 2 == 0))):
            for p, q in zip(probs, got[g][col]):
                at = p * (len(x) - 1)
                a, b = x[math.floor(at)], x[math.ceil(at)]
                assert q == a == b or math.isclose(q, (1 - at % 1) * a + at % 1 * b, rel_tol=1e-12)
    whole = exact_quantiles(df, [], ["v"], [0.5]).collect()
    assert len(whole) == 1 and math.isclose(whole[0].v[0], float(np.median([v for x in groups.values() for v in x])))
    assert exact_quantiles(df.where("false"), ["g"], ["v"], [0.5]).collect() == []


def test_many_draws_of_one_row(spark):
    from weft.operators.ordering import DRAWS, weighted_interleave
    n = 3 * DRAWS + 5
    df = spark.range(n).select(F.lit("big").alias("s"), "id").unionByName(
        spark.createDataFrame([("one", 0), ("two", 0), ("two", 1)], "s string, id long"))
    weights = spark.createDataFrame([("big", 1), ("one", 1), ("two", 1)], "s string, weight int")
    out = weighted_interleave(df, "s", ["id"], weights)
    got = {(r.s, r.n, r.d, r.lo, r.hi) for r in out.groupBy("s").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("draw").alias("d"), F.min("draw").alias("lo"), F.max("draw").alias("hi")).collect()}
    assert got == {(s, n, n, 0, n - 1) for s in ("big", "one", "two")}
    assert out.where("s = 'two' AND draw % 2 <> id").isEmpty()


def test_greedy_numbers_in_large_chunks(spark):
    from weft.operators.batchmap import greedy_batches
    rows = spark.range(60_000).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("t"))
    got = greedy_batches(rows, ["id"], "t", 3, 9).orderBy("id").select("batch").toPandas()["batch"].to_numpy()
    want, batch, held, chars = [], -1, 3, 0
    for i in range(60_000):
        if held == 3 or chars + i % 7 > 9:
            batch, held, chars = batch + 1, 0, 0
        held, chars = held + 1, chars + i % 7
        want.append(batch)
    assert got.tolist() == want
