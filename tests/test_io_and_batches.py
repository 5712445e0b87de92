"""Sources, response validation, batch transformation and tokens."""

import re

import pytest
from pyspark.sql import functions as F

from weft.functions.jsonio import parse_response
from weft.operators import batchmap as L
from weft.operators import tokens as K
from weft.sources import files as IO

from conftest import SF_SMALL


def test_scan_ndjson_failfast_and_audit(spark):
    path = IO.scratch_path(spark, "t-ndjson")
    lines = ['{"a": 1, "b": "x", "zz": 5}', '{"a": 2', 'not json', '{"a": 3, "b": null}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = IO.scan_ndjson_audit(spark, path, IO_SCHEMA)
    assert sorted(r["a"] for r in good.collect()) == [1, 3]
    assert sorted(r["line"] for r in bad.collect()) == sorted(lines[1:3])
    with pytest.raises(IO.DataError):
        IO.raise_if_rows(bad, "bad lines")
    with pytest.raises(Exception):
        IO.scan_ndjson(spark, path, IO_SCHEMA).collect()


IO_SCHEMA = "a bigint, b string"


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a long, b string, c long")
    out, unexpected = IO.require_columns(df, ["b", "a"])
    assert out.columns == ["b", "a"] and unexpected == ["c"]
    with pytest.raises(IO.DataError):
        IO.require_columns(df, ["a", "zz"])


def test_empty_split_keeps_schema(spark):
    path = IO.scratch_path(spark, "t-layout")
    df = spark.createDataFrame([(1, "x", "c1", "train")], "k long, text string, config string, split string")
    IO.write_layout(df, path)
    out = IO.load_split(spark, path, "k long, text string, config string, split string", split="test")
    assert out.count() == 0 and out.columns == ["k", "text", "config", "split"]


def test_validate_manifest_detects_differences(spark):
    c = spark.createDataFrame([("a" * 64, "s1", "train"), ("b" * 64, "s2", "validation")], "id string, source string, split string")
    m = IO.corpus_manifest(c)
    assert IO.validate_manifest(m, c, 2).count() == 0
    bad = IO.validate_manifest(m, c.filter("source = 's1'"), 3)
    assert {r["check"] for r in bad.collect()} == {"row_count", "source_count:s2", "split_count:validation", "fingerprint"}
    other = c.withColumn("id", F.reverse(F.concat(F.col("id"), F.lit("c"))))
    assert [r["check"] for r in IO.validate_manifest(m, other, 2).collect()] == ["fingerprint"]


def test_discover_layout_unknown_raises(spark):
    df = spark.createDataFrame([("c1", "train")], "config string, split string")
    with pytest.raises(IO.DataError):
        IO.discover_layout(df, configs=["nope"])


def test_parse_response_reasons(spark):
    good = '{"translations": [{"id": "1", "translation": " A "}, {"id": "2", "translation": "B"}]}'
    cases = [
        (good, "ok"),
        ("```json\n" + good + "\n```", "ok"),
        ('{"translations": [{"id": "1", "translation": "A"}]}', "count"),
        ('{"translations": [{"id": "2", "translation": "A"}, {"id": "1", "translation": "B"}]}', "ids"),
        ('{"translations": [{"id": "1", "translation": "  "}, {"id": "2", "translation": "B"}]}', "blank"),
        ("not json", "shape"),
        ('{"other": 1}', "shape"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content string")
    out = df.select("i", parse_response("content", F.array(F.lit("1"), F.lit("2"))).alias("r")).orderBy("i").collect()
    for (_, want), r in zip(cases, out):
        assert (r["r"]["reason"] or "ok") == want
    assert [t["translation"] for t in out[0]["r"]["translations"]] == ["A", "B"]


def make_flaky():
    """A client that fails the first call for every batch, then answers."""
    seen = set()

    def flaky(texts):
        key = tuple(texts)
        if key not in seen:
            seen.add(key)
            raise RuntimeError("transient")
        return [t.upper() for t in texts]
    return flaky


def test_apply_batches_retry_halving_and_fallback(spark):
    rows = [(f"k{i}", f"t{i}", i // 4) for i in range(12)]
    df = spark.createDataFrame(rows, "cache_key string, text string, batch long")

    def picky(texts):
        if "t5" in texts:
            raise ValueError("no")
        return [t + "!" for t in texts]

    def never(texts):
        raise RuntimeError("down")

    out = {r["cache_key"]: r for r in L.apply_batches(df, [picky, never], retries=0).collect()}
    assert out["k0"]["translated_text"] == "t0!" and out["k4"]["translated_text"] == "t4!"
    assert out["k5"]["translated_text"] is None and "down" in out["k5"]["error"]
    flaky = {r["cache_key"]: r for r in L.apply_batches(df, [make_flaky()], retries=1, backoff=0.0).collect()}
    assert all(r["translated_text"] == r["cache_key"].replace("k", "T") for r in flaky.values())


def test_apply_batches_keeps_many_batches_of_a_task_apart(spark):
    rows = [(f"k{i:04d}", f"t{i}", g, i // 3) for g in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "cache_key string, text string, g string, batch long").repartition(3)
    out = L.apply_batches(df, [lambda texts: [f"{','.join(texts)}" for _ in texts]], group=["g"], retries=0)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # a Python group per batch took milliseconds each
    got = sorted((r["cache_key"], r["translated_text"]) for r in out.collect())
    want = {i: ",".join(f"t{j}" for j in range(i - i % 3, min(500, i - i % 3 + 3))) for i in range(500)}
    assert got == sorted((f"k{i:04d}", want[i]) for i in range(500) for _ in "ab")


def test_cache_upsert_newest_wins(spark):
    old = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "cache_key string, translated_text string, created_at double")
    new = spark.createDataFrame([("a", "x2", 2.0), ("c", "z", 2.0)], "cache_key string, translated_text string, created_at double")
    got = {r["cache_key"]: r["translated_text"] for r in L.cache_upsert(old, new).collect()}
    assert got == {"a": "x2", "b": "y", "c": "z"}


def test_pieces_match_python_regex(spark):
    texts = ["a  b\r\nc\n\nd ", " x", "▁y", "", "tab\there"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["p"] for r in df.select("i", K.pieces("t").alias("p")).orderBy("i").collect()]
    rx = re.compile(K.PY_PIECE_RE)
    assert got == [rx.findall(t.replace(" ", "▁")) for t in texts]


def test_encode_udf_equals_sql(spark):
    from weft.functions.text import clean_text
    from weft.session import table
    d = table(spark, SF_SMALL, "documents").select("doc_id", clean_text("text").alias("text"))
    vocab = K.word_vocab(K.pretoken_counts(d, "text"), 600)
    a = {r["doc_id"]: r["input_ids"] for r in K.encode_ids(d, "doc_id", "text", vocab, 300).collect()}
    b = {r["doc_id"]: r["input_ids"] for r in K.encode_ids_sql(d, "doc_id", "text", vocab, 300).collect()}
    assert a == b


def test_pack_blocks_matches_loop(spark):
    docs = [(i, list(range(100 * i, 100 * i + (i * 7) % 23 + 1))) for i in range(40)]
    df = spark.createDataFrame(docs, "idx long, input_ids array<int>")
    got = {(r["batch"], r["block"]): r["input_ids"] for r in K.pack_blocks(df, "idx", 8, 10).collect()}
    exp = {}
    for b in range(4):
        toks = []
        for i, ids in docs[b * 10:(b + 1) * 10]:
            toks += ids + [K.EOS]
        usable = len(toks) - len(toks) % 8
        for j in range(0, usable, 8):
            exp[(b, j // 8)] = toks[j:j + 8]
    assert got == exp


def py_bpe(counts, num_merges, min_freq=2):
    from collections import Counter
    words = {tuple(p): n for p, n in counts.items()}
    merges = []
    for r in range(num_merges):
        pairs = Counter()
        for w, n in words.items():
            for a, b in zip(w, w[1:]):
                pairs[(a, b)] += n
        cands = [(c, a, b) for (a, b), c in pairs.items() if c >= min_freq]
        if not cands:
            break
        c, a, b = min(cands, key=lambda x: (-x[0], x[1], x[2]))
        merges.append((r + 1, a, b, c))
        new = {}
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + n
        words = new
    return merges


def test_bpe_merges_match_python(spark):
    counts = {"▁low": 5, "▁lower": 2, "▁newest": 6, "▁widest": 3, "aaaa": 4, "ab$c\\d": 2, "किताब": 3}
    df = spark.createDataFrame(list(counts.items()), "piece string, n long")
    got = [tuple(r) for r in K.bpe_merges(df, 12, checkpoint_every=4).orderBy("rank").collect()]
    assert got == py_bpe(counts, 12)


def test_encoder_embedding_path(spark):
    import numpy as np
    from weft.operators.embed import encoder_embedding, hashed_embedding

    def factory():
        def encode(texts):
            return np.array([[len(t), t.count(" "), 1.0] for t in texts])
        return encode
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k long, t string")
    got = {r["k"]: list(r["embedding"]) for r in encoder_embedding(df, "k", "t", factory, 3, prompt="q: ").collect()}
    assert got == {1: [6.0, 2.0, 1.0], 2: [3.0, 1.0, 1.0], 3: [3.0, 1.0, 1.0]}
    h = {r["k"]: r["embedding"] for r in hashed_embedding(df, "k", "t", 8).collect()}
    assert sum(abs(x) for x in h[1]) <= 2 and h[3] == [0.0] * 8
