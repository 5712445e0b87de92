"""Pieces, ids and masks of many texts at a time against plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weft.operators import tokens as K

_SIGNS = ["a", "b", "é", "日", "😀", "▀", "░", " ", " ", K.METASPACE, "\r", "\n", "\r\n"]


def random_text(rnd, n):
    return "".join(rnd.choice(_SIGNS) for _ in range(rnd.randint(0, n)))


@pytest.mark.parametrize("most", [1, 3, 1 << 62])
def test_pieces_cut_at_once_are_those_of_the_pattern(most):
    rnd, rx = random.Random(most), re.compile(K.PY_PIECE_RE)
    for _ in range(300):
        texts = [random_text(rnd, 25) for _ in range(rnd.randint(0, 6))]
        pieces, places, counts = K.cut_texts(pa.array(texts, pa.string()), most)
        want = [rx.findall(t.replace(" ", K.METASPACE))[:most] for t in texts]
        assert [pieces[i].as_py() for i in places] == [p for w in want for p in w]
        assert counts.tolist() == [len(w) for w in want]


@pytest.mark.parametrize(("max_len", "add_bos"), [(4096, True), (5, True), (5, False)])
def test_encode_ids_equals_the_loop(spark, monkeypatch, max_len, add_bos):
    rnd, rx = random.Random(max_len), re.compile(K.PY_PIECE_RE)
    texts = [random_text(rnd, 40) for _ in range(200)] + ["", None, "ab" * 300, " ".join(["a"] * 300)]
    vocab = {"a": 261, K.METASPACE + "a": 262, "\r\n": 263, "日": 264, K.METASPACE: 265}
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    table = spark.createDataFrame(list(vocab.items()), "piece string, token_id int")
    want = {}
    for k, t in enumerate(texts):
        ids = [K.BOS] if add_bos else []
        for p in rx.findall((t or "").replace(" ", K.METASPACE)):
            ids += [vocab[p]] if p in vocab else [b + K.BYTE_BASE for b in p.encode()]
        want[k] = ids[:max_len]
    for size in (K._TEXT_BYTES, 100):  # some texts are longer than what is cut at once
        monkeypatch.setattr(K, "_TEXT_BYTES", size)
        got = {r.k: r.input_ids for r in K.encode_ids(docs, "k", "text", table, max_len, add_bos).collect()}
        assert got == want


def test_masking_holds_few_positions_at_once():
    rnd = np.random.default_rng(0)
    rows = [rnd.integers(0, 900, 1024).tolist() for _ in range(300)] + [None, [], [5, None, 7], list(range(150_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int32())),
                                        pa.array([f"k{i}" for i in range(len(rows))])], ["i", "input_ids", "_key"])
    out = list(K._drawn(900, 0.3, 4)(iter([batch])))
    assert len(out) >= 5 and all(b.num_rows == 1 or len(b.column(1).flatten()) <= 1 << 16 for b in out)
    got = pa.Table.from_batches(out).to_pylist()
    assert [r["i"] for r in got] == list(range(len(rows)))
    assert got[300]["input_ids"] is None and got[300]["labels"] is None and got[301]["labels"] == []
    for i in (0, 63, 64, 299, 302, 303):
        for k in {0, 1, 2, len(rows[i]) // 2, len(rows[i]) - 1}:
            u = np.frombuffer(hashlib.sha256(f"4:k{i}:{k}".encode()).digest(), ">u4")[:3] / 2.0 ** 32
            t = rows[i][k]
            new = K.MASK if u[1] < 0.8 else int(u[2] * 900) if u[1] < 0.9 else t
            assert (got[i]["input_ids"][k], got[i]["labels"][k]) == ((new, t) if u[0] < 0.3 else (t, -100))
