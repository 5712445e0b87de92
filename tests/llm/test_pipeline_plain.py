"""The pipeline against plain versions of its stages, one after the other, on a whole table."""

import re

import numpy as np
import public_tokenizers
import sentencepiece

SF = "/root/testdata/sf0.001"


def shingles(words, n=5):
    k = min(n, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def one_of_each(rows):
    """The least id of each group of documents that links of 0.8 or more connect."""
    sets = {i: shingles((t or "").lower().split()) for i, t in rows}
    ids = sorted(sets)
    left, out = set(ids), []
    for i in ids:
        if i not in left:
            continue
        out.append(i)
        left.discard(i)
        stack = [i]
        while stack:
            x = sets[stack.pop()]
            near = [j for j in left if x and sets[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j])]
            left.difference_update(near)
            stack += near
    return out


def contains_item(text, items):
    words = re.findall(r"[^\W_]+", text.lower())
    for item in items:
        have = shingles(words, len(next(iter(item))))
        if len(item & have) >= 0.8 * len(item) - 1e-9:
            return True
    return False


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id: r for r in C.quality(spark, docs, SF).collect()}
    assert 0 < len(good) < docs.count()
    unique = one_of_each([(i, r.text) for i, r in good.items()])
    assert len(unique) < len(good)
    items = [shingles(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i in unique if not contains_item(good[i].text or "", [x for x in items if x])]
    assert len(clean) < len(unique)
    kept = spark.createDataFrame([good[i] for i in clean], docs.schema)
    private = {r.doc_id: r for r in C.private_data(spark, kept, SF).collect()}
    assert private.keys() == set(clean) and any(private[i].text != good[i].text for i in clean)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i in clean:
        ids = np.array(sp.encode(private[i].text or ""), "<i4")
        want[i] = (good[i].lang, good[i].source, len(ids), ids.tobytes())
    got = {r.doc_id: (r.lang, r.source, r.n_pieces, bytes(r.piece_ids)) for r in C.run(spark, SF).collect()}
    assert got == want
