"""Draws by bracket against sorting every draw's hashes."""

import hashlib

import pytest


@pytest.mark.parametrize(("seed", "spread_sd"), [("7", 6.0), (None, 6.0), (None, 0.01)])
def test_draws_are_the_first_keys_of_each_hash_order(spark, seed, spread_sd):
    from weft.operators.splits import draw_keys
    sizes = {"a": 40, "b": 3, "c": 0, "d": 5}
    keys = [("a", f"k{i}") for i in range(300)] + [("b", f"x{i}") for i in range(4)] + [("c", "y")] * 2
    keys += [("d", f"z{i}") for i in range(5)] + [("e", "no size"), ("a", None), (None, "q")]
    rows = spark.createDataFrame([(c, k, i) for i, (c, k) in enumerate(keys)], "_cat string, _k string, i long").repartition(3)
    wanted = spark.createDataFrame(list(sizes.items()), "_cat string, _m long")
    got = {r.i: set(r.drawn) for r in draw_keys(rows, wanted, 30, seed, spread_sd).collect()}
    assert got.keys() == set(range(len(keys)))
    want = {i: set() for i in range(len(keys))}
    for d in range(30):
        for c, m in sizes.items():
            mine = [(hashlib.sha256(f"{seed + ':' if seed else ''}{d}:{k}".encode()).hexdigest(), i)
                    for i, (x, k) in enumerate(keys) if x == c and k is not None]
            for _, i in sorted(mine)[:m]:
                want[i].add(d)
    assert got == want


def test_few_hashes_are_ranked(spark):
    """Only the keys inside the bracket are ranked: a small share of many keys."""
    from pyspark.sql import functions as F

    from weft.operators.splits import _draw_bits
    n, q = 40_000, 0.2
    margin = 6 * (q * (1 - q) / n) ** 0.5 + 36 / n
    rows = spark.range(n).select(F.lit("a").alias("_cat"), F.col("id").cast("string").alias("_k"),
                                 F.lit(int((q - margin) * 2 ** 60)).alias("_lo"), F.lit(int((q + margin) * 2 ** 60)).alias("_hi"))
    out = rows.mapInArrow(_draw_bits(4, "1"), "_cat string, _k string, _sure binary, _near array<struct<d:int,h:long>>")
    assert out.select(F.sum(F.size("_near"))).first()[0] < 0.03 * 4 * n
