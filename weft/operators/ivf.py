"""Inverted file over centroids: approximate neighbours with a measured recall (H9), and
exact global ranks that skip what the triangle inequality decides (I4).

Vectors are compared by angle. Centroids are trained on a bounded sample; every vector of
the corpus goes to the cell of its nearest centroid, and a cell is cut into blocks of at
most ``BLOCK`` vectors by their angle to the centroid, so a hot cell is many blocks and a
block is a ring [lo, hi] around its centroid. For a query at angle t from the centroid, all
angles of a ring lie between max(0, t - hi, lo - t) and min(pi, t + hi).

Approximate search compares a query with the blocks of its nearest cells; how many cells
is calibrated on queries whose neighbours were found exactly. Ranks need the number of
vectors above a score: a ring whose bounds lie on one side of it counts wholly or not at
all, and only the others are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import vectors as V
from weft.operators.ordering import positions_in_group
from weft.session import cut_lineage

#: vectors of the training sample, the least by hash of their id
TRAIN_ROWS = 1 << 15
#: numbers of the centroid table and rows of the block table, sent to every executor at most
MAX_CENTROID_NUMBERS = 1 << 24
MAX_BLOCKS = 1 << 20
BLOCK, QUERIES = 4096, 1024


def _rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of a column as unit rows; one that is null or of another length is zero."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), dim))
    fits = lists.value_lengths().fill_null(-1).to_numpy() == dim
    if fits.any():
        flat = lists.filter(pa.array(fits)).flatten().fill_null(np.nan)
        out[fits] = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    return V._unit(out)


def train_centroids(corpus: DataFrame, cells: int, id_col: str = "did", rounds: int = 12, seed: int = 0,
                    sample: int = TRAIN_ROWS) -> np.ndarray:
    """Unit centroids of ``cells`` cells (fewer if there are fewer vectors), fitted to at most
    ``sample`` vectors: those that come first by the hash of their id."""
    first = (corpus.select(id_col, V.as_double("vec").alias("vec")).where("vec IS NOT NULL AND size(vec) > 0")
             .orderBy(F.xxhash64(F.lit(seed), F.col(id_col))).limit(sample).collect())
    if not first:
        return np.zeros((0, 0))
    dim = len(first[0].vec)
    x = V._unit(np.array([r.vec for r in first if len(r.vec) == dim], np.float64))
    x = x[np.linalg.norm(x, axis=1) > 0]
    k = max(1, min(cells, len(x)))
    if k * dim > MAX_CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {dim} numbers are too many to send to every executor")
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((0, dim))
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centroids = V._unit(sums)
    return centroids


def _cells(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                s = _rows(part.column("vec"), dim) @ centroids.T
                cell = s.argmax(axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(angle)],
                                                 [*part.schema.names, "cell", "angle"])

    return run


class Index:
    """The blocks of a corpus: ``rows`` (did, vec, block), ``blocks`` (block, cell, lo, hi, n)."""

    def __init__(self, corpus: DataFrame, cells: int | None = None, block: int = BLOCK, seed: int = 0):
        spark = corpus.sparkSession
        corpus = corpus.select(F.col("did").cast("long").alias("did"), V.as_double("vec").alias("vec"))
        self.size = corpus.count()
        cells = cells or max(1, min(4096, math.isqrt(self.size)))
        self.centroids = train_centroids(corpus, cells, seed=seed)
        self.dim = self.centroids.shape[1]
        self.shared = spark.sparkContext.broadcast(self.centroids)
        if len(self.centroids):
            placed = cut_lineage(corpus.mapInArrow(_cells(self.shared, self.dim),
                                                   "did long, vec array<double>, cell long, angle double"))
        else:
            placed = corpus.withColumns({"cell": F.lit(0).cast("long"), "angle": F.lit(0.0)})
        # positions without the vectors: no task holds a cell
        order = positions_in_group(placed.select("did", "cell", "angle"), ["cell"], ["angle", "did"], "place")
        at = order.select("did", F.struct("cell", F.floor(F.col("place") / block).alias("part")).alias("key"), "angle")
        blocks = at.groupBy("key").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n"))
        blocks = blocks.select("key.cell", "key.part", "lo", "hi", "n")
        found = blocks.limit(MAX_BLOCKS + 1).collect()
        if len(found) > MAX_BLOCKS:
            raise ValueError(f"more than {MAX_BLOCKS} blocks: take larger ones")
        self.blocks = pd.DataFrame(sorted(map(tuple, found)), columns=["cell", "part", "lo", "hi", "n"])
        self.blocks["block"] = np.arange(len(self.blocks))
        names = spark.createDataFrame([(int(c), int(p), int(b)) for c, p, b in
                                       self.blocks[["cell", "part", "block"]].itertuples(index=False)],
                                      "cell long, part long, block long")
        numbered = at.select("did", "key.cell", "key.part").join(F.broadcast(names), ["cell", "part"]).select("did", "block")
        self.rows = cut_lineage(placed.select("did", "vec", "cell").join(numbered, "did").select("did", "vec", "block"))


def _pair_rows(index: Index, pairs: DataFrame) -> tuple:
    """Both sides of the products: queries dealt into groups of about ``QUERIES`` per block,
    and a block's vectors once for each of its groups."""
    per = pairs.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    per = cut_lineage(per.withColumn("groups", F.ceil(F.col("m") / QUERIES).cast("long")).drop("m"))
    q = pairs.join(per, "block").withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups"))).drop("groups")
    d = index.rows.join(per, "block").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    return q.groupBy("block", "group"), d.drop("groups").groupBy("block", "group")


def _near_cells(shared, blocks: pd.DataFrame, dim: int, probes: int):
    """(qid, vec, block) of the blocks of a query's ``probes`` nearest cells."""
    of_cell = {c: b.to_numpy() for c, b in blocks.groupby("cell")["block"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = _rows(part.column("vec"), dim) @ centroids.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                found = [np.concatenate([of_cell.get(c, np.zeros(0, np.int64)) for c in row]) for row in best.tolist()]
                take = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                if len(take):
                    out = part.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([out.column("qid"), out.column("vec"),
                                                      pa.array(np.concatenate(found).astype(np.int64))],
                                                     ["qid", "vec", "block"])

    return run


def _best(dim: int, k: int, exclude_self: bool):
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        qid, did = q.column("qid").to_numpy(), d.column("did").to_numpy()
        out = {"qid": [], "did": [], "score": []}
        if len(qid) and len(did):
            s = np.round(_rows(q.column("vec"), dim) @ _rows(d.column("vec"), dim).T, 12)
            if exclude_self:
                s[qid[:, None] == did[None, :]] = -np.inf
            for i in range(len(qid)):
                order = np.lexsort((did, -s[i]))[:k]
                order = order[np.isfinite(s[i][order])]
                out["qid"].append(np.full(len(order), qid[i]))
                out["did"].append(did[order])
                out["score"].append(s[i][order])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.float64() if c == "score" else pa.int64())
                         for c, v in out.items()})

    return run


def knn(index: Index, queries: DataFrame, k: int, probes: int, exclude_self: bool = False) -> DataFrame:
    """H9, approximate: (qid, did, score, rank) of the k best among the ``probes`` nearest cells."""
    q = queries.select(F.col("qid").cast("long").alias("qid"), V.as_double("vec").alias("vec"))
    if not len(index.centroids):
        return q.sparkSession.createDataFrame([], "qid long, did long, score double, rank int")
    pairs = cut_lineage(q.mapInArrow(_near_cells(index.shared, index.blocks, index.dim, probes),
                                     "qid long, vec array<double>, block long"))
    left, right = _pair_rows(index, pairs)
    found = left.cogroup(right).applyInArrow(_best(index.dim, k, exclude_self), "qid long, did long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def calibrate(index: Index, queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.95,
              exclude_self: bool = False) -> tuple[int, float]:
    """(probes, recall): the least number of cells that finds ``recall`` of the true k nearest
    of ``queries`` (against all rows of ``corpus``), and the share it finds. A neighbour is
    found if the query probes its cell, so the exact neighbours give all recalls at once."""
    exact = V.top_k(queries, corpus, k, exclude_self=exclude_self).select("qid", "did")
    cells = index.rows.select("did", "block").join(
        F.broadcast(exact.sparkSession.createDataFrame([(int(b), int(c)) for b, c in
                                                        index.blocks[["block", "cell"]].itertuples(index=False)],
                                                       "block long, cell long")), "block").select("did", "cell")
    q = queries.select(F.col("qid").cast("long").alias("qid"), V.as_double("vec").alias("vec"))
    dim, shared = index.dim, index.shared

    def order(batches):
        for b in batches:
            s = _rows(b.column("vec"), dim) @ shared.value.T
            place = np.empty(s.shape, np.int64)
            np.put_along_axis(place, np.argsort(-s, axis=1, kind="stable"), np.arange(s.shape[1])[None, :], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(place.tolist(), pa.list_(pa.int64()))],
                                             ["qid", "place"])

    ranks = q.mapInArrow(order, "qid long, place array<long>")
    hits = (exact.join(cells, "did").join(ranks, "qid")
            .select(F.element_at("place", (F.col("cell") + 1).cast("int")).alias("p")).groupBy("p").count())
    found = sorted((r["p"], r["count"]) for r in hits.collect())  # at most one row per cell
    total, seen = sum(n for _, n in found), 0
    for p, n in found:
        seen += n
        if seen >= recall * total:
            return int(p) + 1, seen / total
    return max(1, len(index.centroids)), 1.0


def _packed(dim: int):
    """The vectors of one block as one row."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        did = t.column("did")
        return pa.table({"d_block": pa.array([key[0].as_py()], pa.int64()),
                         "d_ids": pa.array([did.fill_null(0).to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "d_known": pa.array([did.is_valid().to_numpy().tobytes()], pa.binary()),
                         "d_vecs": pa.array([_rows(t.column("vec"), dim).tobytes()], pa.binary())})

    return run


def _above(shared, blocks: pd.DataFrame, dim: int, exclude_self: bool):
    """For every query of a task the vectors above its threshold: those of a block whose bounds
    tell count wholly or not at all, the others are multiplied. A query's own vector is
    taken out of a block that counts wholly."""
    of = blocks.set_index("block")[["cell", "lo", "hi", "n"]].to_dict("index")
    eps = 1e-9  # angles lose digits near 0 and pi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, held = shared.value, {}

        def done():
            for q, _, found in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(q["id"], mask=~q["known"]), *map(pa.array, found)],
                                                 ["qid", "n", "pairs", "products"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
                u = np.frombuffer(x["q_vecs"].as_buffer(), np.float64).reshape(-1, dim)
                name = x["q_block"].as_py()
                if name not in held:
                    if sum(len(q) for q, _, _ in held.values()) >= 2 * V.HELD_QUERIES:
                        yield from done()
                    q = np.frombuffer(x["q_rows"].as_buffer(), V._ROW).copy()
                    held[name] = q, ~u.any(axis=1), np.zeros((3, len(q)), np.int64)
                q, zero, (n, pairs, products) = held[name]
                block = of[x["d_block"].as_py()]
                t = np.arccos(np.clip(u @ centroids[block["cell"]], -1, 1))
                least = np.maximum(np.maximum(t - block["hi"], block["lo"] - t), 0)  # angles of the ring, from
                most = np.minimum(t + block["hi"], np.pi)                            # and to
                above = (np.cos(most) > q["thr"] + eps) & ~zero
                open_ = np.flatnonzero(((np.cos(least) >= q["thr"] - eps) | zero) & ~above)
                pairs += 1
                products[open_] += 1
                n[above] += int(block["n"])
                if not len(open_) and not (exclude_self and above.any()):
                    continue
                did, known = np.frombuffer(x["d_ids"].as_buffer(), np.int64), np.frombuffer(x["d_known"].as_buffer(), "?")
                own = np.flatnonzero(np.isin(q["id"], did[known]) & q["known"]) if exclude_self else np.zeros(0, np.int64)
                for r in own[above[own]].tolist():
                    n[r] -= ((did == q["id"][r]) & known).sum()
                v = np.frombuffer(x["d_vecs"].as_buffer(), np.float64).reshape(-1, dim)
                for at in range(0, len(open_), 512):
                    part = open_[at:at + 512]
                    s = u[part] @ v.T
                    for r in np.flatnonzero(np.isin(part, own)).tolist():
                        s[r, (did == q["id"][part[r]]) & known] = -np.inf
                    n[part] += (s > q["thr"][part][:, None] + V.TIE_EPS).sum(axis=1)
        yield from done()

    return run


def count_above(index: Index, queries: DataFrame, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """((qid, above), (pairs, products)): how many vectors score strictly above ``thr``, and
    how many pairs of a query and a block there were and had to be multiplied. With
    ``exclude_self`` a query's own vector does not count. Queries and blocks are packed and
    checkpointed; a task reads the blocks one after the other for its queries, so neither is
    copied through a shuffle."""
    size = queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(size / V.HELD_QUERIES), min(3 * cores, math.ceil(size / QUERIES)))
    reads = max(1, math.ceil(index.size * index.dim / V.CORPUS_NUMBERS))
    # a vector of another length counts as zero, as it does in the index
    fit = F.when(F.size("vec") == index.dim, V.as_double("vec"))
    qs = V._blocks(queries.select("qid", fit.alias("vec"), "thr"), "qid", (), tasks, QUERIES, index.dim, "q")
    ds = index.rows.groupBy("block").applyInArrow(
        _packed(index.dim), "d_block long, d_ids binary, d_known binary, d_vecs binary")
    ds = cut_lineage(ds.repartition(reads))
    pairs = qs.select("q_block", "q_rows", "q_vecs").join(ds.hint("shuffle_replicate_nl")).coalesce(tasks)
    seen = cut_lineage(pairs.mapInArrow(_above(index.shared, index.blocks, index.dim, exclude_self),
                                        "qid long, n long, pairs long, products long"))
    return seen.groupBy("qid").agg(F.sum("n").alias("above")), seen.agg(F.sum("pairs").alias("pairs"),
                                                                        F.sum("products").alias("products"))


def global_rank(index: Index, queries: DataFrame, best: DataFrame, exclude_self: bool = False) -> DataFrame:
    """I4 by the index: (qid, best_relevant, rank) from the best relevant scores
    (qid, best_relevant): 1 + the vectors that score strictly above."""
    q = queries.select("qid", "vec").join(best.withColumnRenamed("best_relevant", "thr"), "qid")
    above, _ = count_above(index, q, exclude_self)
    return best.join(above, "qid").select("qid", "best_relevant", (F.col("above") + 1).alias("rank"))
