"""Gaps of sparse ids, scripts as a parameter, named datasets, size of a metrics file."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("bucket", [4, 1 << 20])
def test_gaps_of_sparse_ids(spark, bucket):
    from weft.operators.quality import id_gaps
    ids = [-50, -49, -3, 0, 1, 2, 7, 8, 100, 2 ** 40, 2 ** 40 + 2, 2 ** 61, 5, 5]
    got = id_gaps(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long"), "id", bucket).collect()
    s = sorted(set(ids))
    want = [(a + 1, b - 1, b - a - 1) for a, b in zip(s, s[1:]) if b - a > 1]
    assert sorted(map(tuple, got)) == want
    assert id_gaps(spark.createDataFrame([], "id long"), "id", bucket).collect() == []


def test_scripts_are_a_parameter(spark):
    from weft.functions.text import script_class
    df = spark.createDataFrame([(1, "abc"), (2, "абв abc"), (3, "αβγ"), (4, "12"), (5, None)], "i int, t string")
    three = {"Latin": "A-Za-z", "Cyrillic": r"Ѐ-ӿ", "Greek": r"Ͱ-Ͽ"}
    got = {r.i: r.s for r in df.select("i", script_class("t", three).alias("s")).collect()}
    assert got == {1: "Latin only", 2: "Latin + Cyrillic", 3: "Greek only", 4: "Other", 5: "Other"}


def test_datasets_are_loaded_once(spark):
    from weft.sources.datasets import Datasets
    calls = []

    def numbers(s):
        calls.append(1)
        return s.range(3).select(F.col("id").alias("n"))

    data = Datasets(spark, {"numbers": numbers, "bad": numbers}, {"bad": ["n", "text"]})
    assert data.get("numbers") is data.get("numbers") and calls == [1]
    assert spark.sql("SELECT sum(n) FROM numbers").first()[0] == 3
    with pytest.raises(KeyError, match="no dataset 'other'; there are bad, numbers"):
        data.get("other")
    with pytest.raises(ValueError, match="no columns"):
        data.get("bad")


def test_a_large_table_is_no_metrics_file(spark, tmp_path, monkeypatch):
    from weft.sources import files
    monkeypatch.setattr(files, "MAX_CSV_ROWS", 10)
    files.write_metrics_csv(spark.range(10), str(tmp_path / "a"))
    with pytest.raises(files.DataError, match="metrics"):
        files.write_metrics_csv(spark.range(11), str(tmp_path / "b"))


def test_means_of_groups(spark):
    """Partial sums of tasks against a plain mean: nulls, shorter vectors, null groups, no group."""
    import numpy as np

    from weft.operators.vectors import mean_vector
    rng = np.random.default_rng(6)
    rows = [(None if i % 7 == 0 else f"g{i % 5}", int(i % 3), rng.normal(size=4 if i % 4 else 6).tolist()) for i in range(400)]
    rows += [("g1", 0, None), ("g1", 0, []), ("g2", 1, [None, 2.0, None])]
    df = spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(5)
    for group in (["g"], ["g", "h"], []):
        got = {tuple(r[c] for c in group): r["mean"] for r in mean_vector(df, group, "v", normalize=False).collect()}
        want = {}
        for g, h, v in rows:
            for i, x in enumerate(v or []):
                if x is not None:
                    want.setdefault(tuple({"g": g, "h": h}[c] for c in group), {}).setdefault(i, []).append(x)
        assert got.keys() == want.keys()
        for k, cells in want.items():
            assert np.allclose(got[k], [np.mean(cells[i]) for i in sorted(cells)], rtol=1e-12)


def test_mask_tokens_by_one_digest_in_python(spark):
    import hashlib

    from weft.operators import tokens as K
    rows = [("a", [7, 8, 9] * 40), (None, [1, None, 3]), ("n", None), ("e", [])]
    out = K.mask_tokens(spark.createDataFrame(rows, "k string, input_ids array<int>"), "k", 50, 0.3, 4)
    assert "sha2" not in out._jdf.queryExecution().toString()  # a lambda over every position in SQL took microseconds
    got = {r["k"]: (r["input_ids"], r["labels"]) for r in out.collect()}
    assert got["n"] == (None, None) and got["e"] == ([], [])
    for key, ids in rows[:2]:
        for i, t in enumerate(ids):
            h = hashlib.sha256(f"4:{key}:{i}".encode() if key else f"4:{i}".encode()).hexdigest()
            u, how, r = (int(h[x:x + 8], 16) / 2 ** 32 for x in (0, 8, 16))
            want = (t, -100) if u >= 0.3 else (K.MASK if how < 0.8 else int(r * 50) if how < 0.9 else t, t)
            assert (got[key][0][i], got[key][1][i]) == want
