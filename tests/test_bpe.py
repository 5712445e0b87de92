"""Byte-pair learning against the plain loop, encoding against applying merges one by one."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weft.operators import bpe as B
from weft.operators.tokens import BYTE_BASE, FIRST_PIECE_ID, METASPACE


def plain_learn(counts, merges, least):
    """One merge at a time, everything counted anew."""
    words = [(list(p), n) for p, n in counts.items()]
    tokens, out = {c for p in counts for c in p}, []
    while len(out) < merges:
        pairs = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] += n
        open_ = [(-c, *p) for p, c in pairs.items() if c >= least and "".join(p) not in tokens]
        if not open_:
            break
        c, a, b = min(open_)
        tokens.add(a + b)
        out.append((a, b, -c))
        words = [(plain_merge(w, a, b), n) for w, n in words]
    return out


def plain_merge(w, a, b):
    out, k = [], 0
    while k < len(w):
        if k + 1 < len(w) and (w[k], w[k + 1]) == (a, b):
            out.append(a + b)
            k += 2
        else:
            out.append(w[k])
            k += 1
    return out


def random_counts(seed, n=300):
    rnd = random.Random(seed)
    parts = ["th", "e", "an", "aaa", "ab", "ba", "x", "ing", "ed", "é", "😀", "bb"]
    made = Counter()
    for _ in range(n):
        made[METASPACE * rnd.randint(0, 1) + "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))] += rnd.choice([1, 1, 2, 30])
    return made


@pytest.mark.parametrize(("seed", "max_runs"), [(1, 10 ** 6), (2, 40), (3, 5), (4, 1)])
def test_merges_are_those_of_the_plain_loop(spark, seed, max_runs):
    counts = random_counts(seed)
    table = spark.createDataFrame([(p, n, "x") for p, n in counts.items()], "piece string, n long, w string").repartition(3)
    got = B.learn_bpe(table, num_merges=120, max_runs=max_runs).collect()
    fixed = [r for r in got if r.kind != "merge"]
    assert [r.token_id for r in got] == list(range(len(got)))
    assert [r.token for r in fixed[FIRST_PIECE_ID:]] == sorted({c for p in counts for c in p})
    assert (fixed[0].token, fixed[5].token, fixed[260].token) == ("<unk>", "<0x00>", "<0xFF>")
    merges = [(r.left, r.right, r["count"]) for r in got if r.kind == "merge"]
    assert merges == plain_learn(counts, 120, 2)
    assert [r.token for r in got if r.kind == "merge"] == [a + b for a, b, _ in merges]


def test_rounds_are_few(spark):
    """Hundreds of merges in a few rounds although only a fraction of the runs fits."""
    counts = random_counts(7, 4000)
    table = spark.createDataFrame(list(counts.items()), "piece string, n long")
    jobs = []
    real = B.merge_runs
    try:
        B.merge_runs = lambda *a: jobs.append(len(a[0])) or real(*a)
        got = B.learn_bpe(table, num_merges=400, max_runs=len(counts) // 4)
    finally:
        B.merge_runs = real
    assert got.where("kind = 'merge'").count() == 400
    assert 1 < len(jobs) <= 12


def test_a_round_writes_the_packed_pieces_once(spark):
    """One frame of few rows per round: neither pairs nor pieces are written one by one, nor after the last round."""
    counts = random_counts(11, 1500)
    counts |= {"ab" * 3000: 3, "x": 7, "😀😀😀é": 5}
    table = spark.createDataFrame(list(counts.items()), "piece string, n long").repartition(3)
    rounds, written = [], []
    learn, cut = B.merge_runs, B.cut_lineage

    def kept(df):
        out = cut(df)
        written.append(out.count())
        return out

    try:
        B.merge_runs, B.cut_lineage = lambda *a: rounds.append(a[1]) or learn(*a), kept
        got = B.learn_bpe(table, num_merges=150, max_runs=300)
    finally:
        B.merge_runs, B.cut_lineage = learn, cut
    assert [(r.left, r.right, r["count"]) for r in got.collect() if r.kind == "merge"] == plain_learn(counts, 150, 2)
    assert len(rounds) > 1 and len(written) == len(rounds) and max(written) <= 8


def test_vocabulary_size_ends_the_learning(spark):
    table = spark.createDataFrame(list(random_counts(9).items()), "piece string, n long")
    vocab = B.learn_bpe(table, vocab_size=300)
    assert vocab.count() == 300
    empty = B.learn_bpe(table.where("false"))
    assert empty.count() == FIRST_PIECE_ID
    odd = spark.createDataFrame([(None, 5), ("", 5), ("ab", 1), ("ab", 1), ("q", 9)], "piece string, n long")
    assert [(r.token, r["count"]) for r in B.learn_bpe(odd).where("kind = 'merge'").collect()] == [("ab", 2)]


def test_ranked_merges_equal_merges_in_turn():
    rnd = random.Random(3)
    merges = [(a, b) for a, b, _ in plain_learn(random_counts(5), 150, 2)]
    ranks = {m: i for i, m in enumerate(merges)}
    for _ in range(300):
        w = [rnd.choice("thea nbxéig") for _ in range(rnd.randint(0, 40))]
        want = list(w)
        for a, b in merges:
            want = plain_merge(want, a, b)
        assert B.apply_merges(w, ranks) == want
    long = B.apply_merges(["a"] * 200_000, {("a", "a"): 0, ("aa", "aa"): 1})
    assert long == ["aaaa"] * 50_000


def test_encode_and_decode(spark):
    table = spark.createDataFrame(list(random_counts(5).items()), "piece string, n long")
    vocab = B.learn_bpe(table, num_merges=100)
    ids = {r.token: r.token_id for r in vocab.collect()}
    texts = ["than the  ab\nba", "", None, "日本 aaa", "x" * 5000, "<mask> a", "\r\n\r", " lead and trail "]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.input_ids for r in B.encode(docs, "k", "text", vocab, None).collect()}
    assert got[1] == got[2] == [1]
    assert got[3][1:4] == [BYTE_BASE + b for b in "日".encode()]
    assert got[7][1] in (ids[METASPACE], ids.get(METASPACE + "l", -1)) or got[7][1] < FIRST_PIECE_ID
    back = {r.k: r.text for r in B.decode(B.encode(docs, "k", "text", vocab, None), "k", "input_ids", vocab).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    cut = {r.k: r.input_ids for r in B.encode(docs, "k", "text", vocab, 7).collect()}
    assert all(cut[k] == got[k][:7] for k in got)
    assert {r.k: r.input_ids for r in B.encode(docs, "k", "text", vocab, None, add_bos=False).collect()} == {k: v[1:] for k, v in got.items()}


def test_an_encoder_remembers_pieces_by_their_length():
    encoder = B.Encoder([])
    for i in range(300):  # distinct pieces of 20,000 characters
        assert len(encoder.piece(f"{i:05}" * 4000)) == 20_000
    assert sum(map(len, encoder.memory)) <= 1 << 21
    assert list(encoder.piece("ab")) == list(encoder.piece("ab")) and "ab" in encoder.memory


def test_pieces_merged_together_equal_pieces_one_by_one():
    """Also where characters, merges or tokens are missing, and where the merges are not in an order to go by."""
    for seed, how in enumerate(["", "", "no characters", "no merges", "no tokens", "shuffled"]):
        rnd = random.Random(seed)
        merges = [(a, b) for a, b, _ in plain_learn(random_counts(seed), 100, 2)]
        chars = sorted({c for p in random_counts(seed) for c in p})[3 if how == "no characters" else 0:]
        if how == "no merges":
            merges = [m for i, m in enumerate(merges) if i % 7]
        if how == "shuffled":
            rnd.shuffle(merges)
        vocab = [(c, None, None) for c in chars] + [(a + b, a, b) for a, b in merges]
        vocab = [(FIRST_PIECE_ID + i, "?" * i if how == "no tokens" and i % 5 == 1 else t, a, b) for i, (t, a, b) in enumerate(vocab)]
        together, single = B.Encoder(vocab), B.Encoder(vocab)
        for _ in range(20):
            made = {"".join(rnd.choice(["th", "e", "a", "a", "b", "x", "é", "日", METASPACE, "ing"])
                            for _ in range(rnd.choice([1, 3, 6, 30, 90]))) for _ in range(rnd.randint(0, 40))}
            ids, sizes = together.pieces(pa.array(list(made), pa.string()))
            ends = np.cumsum(sizes)
            assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes)] == [list(single.piece(p)) for p in made]


def test_short_pieces_are_not_merged_one_by_one(spark, monkeypatch):
    counts = random_counts(5)
    vocab = [tuple(r) for r in B.learn_bpe(spark.createDataFrame(list(counts.items()), "piece string, n long"), num_merges=100)
             .select("token_id", "token", "left", "right").collect()]
    encoder, one = B.Encoder(vocab), []
    monkeypatch.setattr(B, "apply_merges", lambda s, r, real=B.apply_merges: one.append(len(s)) or real(s, r))
    encoder.pieces(pa.array([*counts, "th" * 200], pa.string()))
    assert one == [400]
