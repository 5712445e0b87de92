"""Edge inputs and brute-force comparisons of the text operators: nulls in any
column, empty and long texts, repeated rows, empty tables, clashing extra columns."""

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, block string, th string"
LONG = "alpha beta  gamma\n" * 3000
BASE = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    return [(1, BASE, "en", "s", 1, 9, "x", None), (1, BASE, "en", "s", 1, 9, "x", None), (2, BASE, None, None, None, None, None, None),
            (3, BASE + " thirteen", "en", "s", 1, 9, "x", "y"), (4, "", "en", "s", 0, 1, "", ""), (5, None, "en", "s", 0, 1, "", ""),
            (None, "Hello  World, it's me! <|endoftext|>", "en", "s", 1, 1, "", ""), (6, LONG, "en", "s", 1, 1, "", ""),
            (7, " \t\n ", "en", "s", 1, 1, "", ""), (8, "naïve ÉCOLE ß 日本語 😀 x\x85y", "fr", "s", 1, 1, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 6)) for x in r)


def sort(found):
    return sorted(found, key=key)


# ---- n-gram scores -----------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_ngram_scores(docs, order):
    from weft.llm.ngram_trie import ngram_scores
    got = ngram_scores(docs, F.col("doc_id") % 4 != 0, order=order, strength=2.0, discount=0.5).collect()
    text = {(i, t): ((t or "").encode().lower().split() + [0], i is not None and i % 4 != 0) for i, t, *_ in rows()}
    train = [t for r in rows() for t, flag in [text[r[0], r[1]]] if flag]
    c = Counter(w for t in train for w in t)
    full, context = Counter(), Counter()
    for t in train:
        p = [1] * (order - 1) + t
        for k in range(len(t)):
            full[tuple(p[k:k + order])] += 1
            context[tuple(p[k:k + order - 1])] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows():
        words, flag = text[i, t]
        p, base, score = [1] * (order - 1) + words, 0.0, 0.0
        for k, w in enumerate(words):
            base += log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
            pw = (c[w] - 0.5) / n if c[w] else 0.5 * v / n
            if order > 1:
                pw = (full[tuple(p[k:k + order])] + 2 * pw) / (context[tuple(p[k:k + order - 1])] + 2)
            score += log10(pw)
        want.append((i, not flag, len(words), sum(c[w] > 0 for w in words), n, base, score))
    assert [key(r) for r in sort(tuple(r) for r in got)] == [key(r) for r in sort(want)]


def test_ngram_scores_without_rows(spark, docs, empty):
    from weft.llm.ngram_trie import ngram_scores
    assert ngram_scores(empty, F.lit(True)).collect() == []
    got = ngram_scores(docs, F.lit(None).cast("boolean")).collect()
    assert len(got) == len(rows()) and all(r["held_out"] and r["n_known"] == 0 for r in got)


def test_elias_fano():
    from weft.llm.elias_fano import Sequence, encode
    rng = np.random.default_rng(1)
    for n, u in ((0, 5), (1, 1), (300, 300), (2000, 1 << 48)):
        v = np.unique(rng.integers(0, u, n).astype(np.uint64))
        s = Sequence(encode(v, u))
        q = rng.integers(0, u, 500).astype(np.uint64)
        assert (s.get(np.arange(len(v))) == v).all()
        assert (s.successor(q) == np.searchsorted(v, q)).all()
        assert (s.find(v) == np.arange(len(v))).all()


# ---- repeated spans -----------------------------------------------------------

def brute_spans(table, length):
    words = [(i, (t or "").encode().split()) for i, t, *_ in table]
    c = Counter(tuple(w[k:k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if c[tuple(w[k:k + length])] > 1:
                gone.update(range(k, k + length))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sort(out)


@pytest.mark.parametrize("length,k", [(5, 2), (12, 8), (35, 8)])
def test_repeated_spans(docs, length, k):
    from weft.llm.repeated_spans import digest, remove_repeated
    got = digest(remove_repeated(docs, length, k)).collect()
    assert sort(tuple(r) for r in got) == brute_spans(rows(), length)


@pytest.mark.parametrize("hot", [1, 3])
def test_repeated_spans_hot_anchors(docs, hot):
    """Anchors divided by whole windows give the same spans."""
    from weft.llm.repeated_spans import digest, remove_repeated
    for length, k in ((5, 2), (12, 8)):
        got = digest(remove_repeated(docs, length, k, hot=hot)).collect()
        assert sort(tuple(r) for r in got) == brute_spans(rows(), length)


def test_hot_anchor_is_divided():
    """A passage in 5,000 documents, with other words around it: no shard holds the most of it."""
    import pandas as pd
    import pyarrow as pa

    from weft.llm import repeated_spans as R
    from weft.llm.common import Hashes
    rnd, hashes, n = random.Random(4), Hashes(), 8
    phrase = min((["%06x" % rnd.randrange(1 << 24) for _ in range(8)] for _ in range(3000)),
                 key=lambda w: int(R.gram_hashes(hashes.array([x.encode() for x in w]), 8)[0]))
    word = lambda: "%06x" % rnd.randrange(1 << 24)
    texts = [" ".join([word() for _ in range(30)] + phrase + [word() for _ in range(30)]).encode() for _ in range(5000)]
    ids = pa.array(range(5000), pa.int64())
    first = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), ids], ["id", "text", "th"])
    sent = pd.concat([b.to_pandas() for b in R._anchor_rows(35, 8, n)(iter([first]))])
    shared = pd.concat([R._shared_anchors(g) for _, g in sent.groupby("shard")])
    found = R._gather(np.uint64)(shared)
    what = {i: w for i, w in zip(found["id"], found["what"], strict=True)}
    assert len(what) == 5000
    flags = pa.array([{"th": i, "anchors": [what[i]]} for i in range(5000)])
    second = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), flags], ["id", "text", "found"])
    size = [0] * n
    for b in R._segment_rows(35, 8, n)(iter([second])):
        for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            size[s] += len(p)
    # the home shard of the one block also holds its places; the others share the windows
    assert sum(sorted(size)[:-1]) > 0.5 * sum(size) and sorted(size)[-2] < 2 * sorted(size)[0]


def test_repeated_spans_empty(empty):
    from weft.llm.repeated_spans import remove_repeated
    assert remove_repeated(empty).collect() == []


def test_automaton_counts_windows():
    from weft.llm.repeated_spans import repeated
    rnd = random.Random(2)
    for _ in range(150):
        length, v = rnd.randint(1, 5), rnd.choice([1, 2, 4])
        times = Counter(tuple(rnd.randrange(v) for _ in range(rnd.randint(length, 10))) for _ in range(4))
        segments = list(times)
        c = Counter()
        for s, n in times.items():
            for i in range(len(s) - length + 1):
                c[s[i:i + length]] += n
        want = [[i for i in range(len(s) - length + 1) if c[s[i:i + length]] > 1] for s in segments]
        assert repeated([list(s) for s in segments], list(times.values()), length) == want


# ---- tokens ---------------------------------------------------------------------

def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts(docs, empty):
    from weft.llm.token_counts import library_counter, token_counts
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = library("byte_bpe_50k.json")
    got = token_counts(docs, library_counter(path), limit=10).collect()
    want = []
    for i, t, *_ in rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 10))
    assert sort(tuple(r) for r in got) == sort(want)
    assert token_counts(empty, library_counter(path)).collect() == []


def test_hot_parts_are_dealt_over_the_shards():
    """The postings of a part that all documents hold spread over the shards, block by block."""
    import pyarrow as pa

    from weft.llm import token_counts as T
    text = b"the " * 3 + b"cat"
    batches = [pa.RecordBatch.from_arrays([pa.array(range(1 << 15)), pa.array([text] * (1 << 15))], ["id", "text"])] * 12
    sent = {}
    for b in T._route(8)(iter(batches)):
        for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            doc = T.unpack(payload, np.int64, np.uint32, np.uint8, np.uint32, np.uint16, np.uint16, np.int64, np.uint8, np.int64)[4]
            sent[shard] = sent.get(shard, 0) + len(doc)
    assert sum(sent.values()) == 12 * 3 * (1 << 15) and max(sent.values()) < sum(sent.values()) / 2


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17])
def test_bit_packing(bits):
    from weft.llm.packed_ids import pack_ids, read_block, unpack_ids, write_block
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = pack_ids(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (unpack_ids(data, 1001, bits) == ids).all()
    two = write_block([5, 6], [ids[:10], ids[:0]], bits) + write_block([7], [ids], bits)
    doc_ids, null, counts, got, after = read_block(two)
    assert (list(doc_ids), list(null), list(counts), (got == ids[:10]).all()) == ([5, 6], [False, False], [10, 0], True)
    assert (read_block(two, after)[3] == ids).all()
    marked = read_block(write_block([None, -1, 0], [ids[:1]] * 3, bits))
    assert (list(marked[0]), list(marked[1])) == ([0, -1, 0], [True, False, False])


def test_packed_ids(docs, empty):
    from weft.llm.packed_ids import LibraryEncoder, packed_ids
    encoder = LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    tok = library("word_bpe_49k.json")
    got = [tuple(r)[:4] for r in packed_ids(docs, encoder, 49408, 1).collect()]
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t, *_ in rows()), key=lambda r: (r[0] is not None, r[0], r[1].encode())):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sort(got) == sort(want)
    assert packed_ids(empty, encoder, 49408, 1).collect() == []


@pytest.mark.parametrize("vocab", [100, 49408])
def test_negative_and_null_ids_and_single_documents(spark, tmp_path, vocab):
    """Ids below 0 are ids; one document is reached through the block table."""
    from weft.llm.packed_ids import packed_ids, read_document
    ids = [-5, -1, None, 3, 3, 0, None, 7 * 10 ** 12, *range(100, 160)]
    table = spark.createDataFrame([(i, "x" * n) for n, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    path = str(tmp_path / "ids")
    got = packed_ids(table, lambda texts: [np.arange(len(t), dtype="<u4") for t in texts], vocab, 99, path=path).collect()
    want, start = [], 0
    for i, n in sorted(((i, n) for n, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((i, start, n + 1, zlib.crc32(np.array([*range(n), 99], "<u4").tobytes())))
        start += n + 1
    assert sort(tuple(r)[:4] for r in got) == sort(want)
    assert [x.tolist() for x in read_document(spark, path, -5)] == [[99]]
    assert sorted(len(x) for x in read_document(spark, path, 3)) == [4, 5]
    assert read_document(spark, path, 5) == []


# ---- pieces ----------------------------------------------------------------------

def test_piece_scan_chunks():
    """Chunks of any size give the library's ids."""
    import sentencepiece

    from weft.llm import piece_scan as S
    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp, rnd = S.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    parts = ["the", "internationalization", "aaaa", "  ", " ", "\n", "日本", "é", "▁", "00", "x", "\x00"]
    for _ in range(150):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        w, c = "▁" + t.replace(" ", "▁"), rnd.choice([1, 2, 5, 20])
        chunks = [S.Chunk(m, w[max(0, i - 64):i], w[i:i + c], w[i + c:i + c + 64]) for i in range(0, len(w), c)]
        states = S.boundary_states([x.matrix() for x in chunks])
        got = b"".join(x.trace(i, j) for x, (i, j) in zip(chunks, states, strict=True))
        assert np.frombuffer(got, "<i4").tolist() == sp.encode(t) == m.encode(t).tolist()


@pytest.mark.parametrize("chunk", [700, 1 << 15])
def test_piece_scan_table(docs, empty, chunk):
    import sentencepiece

    from weft.llm import piece_scan as S
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = S.encode_ids(docs, path, chunk=chunk)
    assert encoded.columns == [*docs.columns, "piece_ids"]
    got = S.digest(S.decode_ids(encoded, path)).collect()
    want = [(i, len(e), zlib.crc32(np.array(e, "<i4").tobytes()), True) for i, t, *_ in rows() for e in [sp.encode(t or "")]]
    assert sort(tuple(r) for r in got) == sort(want)
    assert S.encode_ids(empty, path).collect() == []


def test_trie_levels_are_built_and_searched_in_parts():
    import tracemalloc

    from weft.llm import elias_fano as EF
    values = np.arange(1 << 20, dtype=np.uint64) * np.uint64(37)
    tracemalloc.start()
    try:
        made = EF.encode(values, 1 << 27)
        encoded = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        found = EF.Sequence(made).find(values)
        searched = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (found == np.arange(1 << 20)).all()
    assert max(encoded, searched) < 48 << 20  # six numbers a value; there were some twenty
