"""Recall of the searches on the given tables, against all rows, for the queries with an id
divisible by 100 (near copies are planted where the table holds none)."""

import numpy as np

SF = "/root/testdata/sf0.01"


def test_ngram_join_finds_all_links(spark):
    from weft.llm.queries import QUERIES
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if k else set()
    got = {r.doc_id: r.n_links for r in QUERIES["op10_chosen_path"](spark, SF).collect()}
    want = {i: sum(1 for j, y in sets.items() if j != i and x and y and len(x & y) >= 0.8 * len(x | y))
            for i, x in sets.items() if i % 100 == 0}
    # documents in near-duplicate groups too: the hundredth ids alone hold few links
    some = [i for i, n in got.items() if n][:150]
    want |= {i: sum(1 for j, y in sets.items() if j != i and y and len(sets[i] & y) >= 0.8 * len(sets[i] | y)) for i in some}
    assert sum(want.values()) > 50
    assert sum(min(got[i], n) for i, n in want.items()) >= 0.999 * sum(want.values())
    assert all(got[i] <= n for i, n in want.items())


def test_vector_links_find_all_near_copies(spark):
    from weft.llm.vector_links import vector_links
    rows = [(r.vec_id, np.array(r.embedding, np.float64), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    made = list(rows)
    for i, v, label in rows:
        if i % 100 == 0:
            for k in range(40):  # cosines around the threshold
                noise = rng.standard_normal(len(v))
                noise *= rng.uniform(0.05, 0.3) * np.linalg.norm(v) / np.linalg.norm(noise)
                made.append((10 ** 6 + 100 * i + k, v + noise, label))
    table = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in made], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_links(table).collect()}
    x = np.array([v for _, v, _ in made])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([label for *_, label in made])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    want = {i: int(n) - 1 for (i, *_), n in zip(made, near.sum(axis=1))}
    assert sum(want.values()) > 500
    assert got == want
