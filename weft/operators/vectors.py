"""Dense vectors: normalization, means, pairwise and all-pairs cosine.

Row-aligned math stays in built-in array expressions (``zip_with`` /
``aggregate``). All-pairs scoring is quadratic by definition, so it runs as
block pairs: queries and corpus are packed into blocks of bounded size, a task
goes through the corpus blocks with its blocks of queries, and NumPy does one
matrix product per pair. A task emits only the top-k of its queries (or a
per-query statistic), never the score matrix; a bounded per-query merge
follows. Memory per task is bounded whatever the data size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.session import cut_lineage

BLOCK_Q = 2048
BLOCK_D = 4096
# Scores recomputed in another block layout may differ in the last bits;
# "strictly above" means above by more than this.
TIE_EPS = 1e-12


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(vec: str | Column) -> Column:
    return F.transform(_c(vec), lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products in double."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """H4: row-aligned cosine; 0 when either vector is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def l2_normalize(a: str | Column) -> Column:
    """H3: unit length; a zero vector is returned unchanged."""
    n = norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def concat_normalize(a: str | Column, b: str | Column) -> Column:
    """H6: normalize(a ++ b)."""
    return l2_normalize(F.concat(as_double(a), as_double(b)))


def check_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """H2: rows, NULL vectors, wrong-length vectors, distinct lengths."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(vec).isNull()).alias("null_vectors"),
        F.count_if(F.size(vec) != dim).alias("wrong_dim"),
        F.countDistinct(F.size(vec)).alias("distinct_dims"),
        F.count_if(F.size(vec) <= 0).alias("empty_vectors"))


#: numbers that a task holds before it sends its sums on
_HELD = 1 << 22


def _partial_sums(n_keys: int):
    """(key.., position, sum, count) of the vectors of each key in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        kinds: list = []
        size = 0

        def rows():
            keys = list(held)
            dims = [len(held[k][0]) for k in keys]
            at = np.repeat(np.arange(len(keys)), dims)
            columns = [pa.array([k[c] for k in keys], kinds[c]).take(pa.array(at)) for c in range(n_keys)]
            sums, counts = (np.concatenate([held[k][i] for k in keys]) for i in (0, 1))
            some = pa.array(counts > 0)
            columns += [pa.array(np.concatenate([np.arange(d) for d in dims]), pa.int32()), pa.array(sums),
                        pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [*names, "_pos", "_s", "_n"]).filter(some)

        for b in batches:
            names, kinds = b.schema.names[:n_keys], [b.schema.types[c] for c in range(n_keys)]
            vectors = b.column(n_keys)
            keys = list(zip(*(c.to_pylist() for c in b.columns[:n_keys]), strict=True)) if n_keys else [()] * b.num_rows
            kinds_of = list(dict.fromkeys(keys))
            number = {k: i for i, k in enumerate(kinds_of)}
            code = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
            x = vectors.flatten()
            length = np.diff(vectors.offsets.to_numpy())
            x, there = x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy(zero_copy_only=False)
            first = np.cumsum(length) - length
            for d in np.unique(length).tolist():  # all rows of a length at once
                if not d:
                    continue
                mine = np.flatnonzero(length == d)
                order = mine[np.argsort(code[mine], kind="stable")]
                cells = first[order][:, None] + np.arange(d)
                begins = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums, counts = np.add.reduceat(x[cells], begins), np.add.reduceat(there[cells].astype(np.int64), begins)
                for c, s, n in zip(code[order][begins].tolist(), sums, counts, strict=True):
                    old = held.get(kinds_of[c])
                    if old is None:
                        held[kinds_of[c]] = [s.copy(), n.copy()]
                        size += 2 * d
                        continue
                    if len(old[0]) < d:
                        size += 2 * (d - len(old[0]))
                        old[0], old[1] = (np.concatenate([o, np.zeros(d - len(o), o.dtype)]) for o in old)
                    old[0][:d] += s
                    old[1][:d] += n
            if size >= _HELD:
                yield rows()
                held.clear()
                size = 0
        if held:
            yield rows()

    return run


def mean_vector(df: DataFrame, group: Sequence[str], vec: str, normalize: bool = True,
                out_col: str = "mean") -> DataFrame:
    """H7: per-group component-wise mean (then unit length).

    Every task adds up the vectors of each of its groups and sends one row per group and
    component, so neither rows nor a hot group's vectors are exploded or gathered. Null
    vectors and components are left out; shorter vectors count where they reach.
    """
    keys = df.select(*group).schema.fields
    rows = df.select(*group, as_double(vec).alias("_v")).where(F.col("_v").isNotNull())
    out = T.StructType([*keys, T.StructField("_pos", T.IntegerType()), T.StructField("_s", T.DoubleType()),
                        T.StructField("_n", T.LongType())])
    parts = rows.mapInArrow(_partial_sums(len(keys)), out)
    comp = parts.groupBy(*group, "_pos").agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    packed = comp.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_s"))
    mean = F.transform("_s", lambda s: s["_m"])
    out = packed.select(*group, mean.alias(out_col))
    return out.withColumn(out_col, l2_normalize(out_col)) if normalize else out


# ---------------------------------------------------------------- block pairs

#: queries whose best a task holds, and numbers of the corpus that a task reads at once
HELD_QUERIES, CORPUS_NUMBERS = 1 << 15, 1 << 23

_BLOCK_SCHEMA = "_lo string, _hi string, _groups array<string>, _rows binary, _vecs binary"
_ROW = np.dtype([("id", "<i8"), ("known", "?"), ("lab", "<i8"), ("labelled", "?"), ("thr", "<f8"), ("g", "<i4"),
                 ("dim", "<i4")])


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, n, out=np.zeros_like(mat), where=n > 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``dim`` numbers, shorter ones (of other groups) followed by zeros and null
    ones zero, and their lengths (-1: null)."""
    lists = pa.concat_arrays(column.chunks)
    length = lists.value_lengths().fill_null(-1).to_numpy()
    cells = np.arange(dim)[None, :] < length[:, None]
    out = np.zeros((len(length), dim))
    out[cells] = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
    return out, length


def _lengths(rows: np.ndarray, groups: int) -> np.ndarray:
    """The length of the vectors of each group; they may differ only between groups."""
    out = np.full(groups, -1)
    np.maximum.at(out, rows["g"], rows["dim"])
    if ((rows["dim"] >= 0) & (rows["dim"] != out[rows["g"]])).any():
        raise ValueError("vectors of several lengths in a group")
    return out


def _pack(block: int, dim: int):
    """Rows of a task, sorted by group, as blocks of at most ``block``: unit vectors and what goes with them."""
    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        groups = t.column("_g").to_pylist()
        names = list(dict.fromkeys(groups))
        number = {g: i for i, g in enumerate(names)}
        rows = np.zeros(t.num_rows, _ROW)
        for name, valid, column in (("id", "known", "_id"), ("lab", "labelled", "_lab")):
            rows[name] = t.column(column).fill_null(0).to_numpy()
            rows[valid] = t.column(column).is_valid().to_numpy()
        rows["thr"] = t.column("_thr").fill_null(np.nan).to_numpy()
        rows["g"] = [number[g] for g in groups]
        vectors, rows["dim"] = _matrix(t.column("_vec"), dim)
        cells = ([groups[0]], [groups[-1]], [names], [rows.tobytes()], [_unit(vectors).tobytes()])
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)],
                                          ["_lo", "_hi", "_groups", "_rows", "_vecs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, block - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == block:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return run


def _blocks(df: DataFrame, id_col: str, group: Sequence[str], parts: int, block: int, dim: int, prefix: str) -> DataFrame:
    """``df`` in ``parts`` partitions of packed blocks; every row moves once."""
    def given(name, kind):
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    key = F.to_json(F.struct(*group)) if group else F.lit("")
    rows = df.select(key.alias("_g"), F.col(id_col).cast("bigint").alias("_id"), as_double("vec").alias("_vec"),
                     given("lab", "bigint").alias("_lab"), given("thr", "double").alias("_thr"))
    if group:  # blocks of few groups
        rows = rows.repartitionByRange(parts, "_g", F.xxhash64("_id")).sortWithinPartitions("_g")
    else:
        rows = rows.repartition(parts, "_id")
    made = rows.mapInArrow(_pack(block, dim), _BLOCK_SCHEMA).withColumn("_block", F.monotonically_increasing_id())
    return cut_lineage(made.select(*[F.col(c).alias(prefix + c) for c in made.columns]))


class _Best:
    """The k best documents of a block of queries so far; ties go to the lower id."""

    def __init__(self, n: int, k: int):
        self.k, self.bar = k, np.full(n, -np.inf)
        self.kept: list[tuple] = []
        self.pending, self.limit = 0, 2 * n * k + (1 << 16)

    def add(self, at: int, s: np.ndarray, d: np.ndarray) -> None:
        bar = self.bar[at:at + len(s)]
        if s.shape[1] > 4 * self.k and np.isneginf(bar).any():
            top = np.where(np.isnan(s), -np.inf, s)
            bar = np.maximum(bar, np.partition(top, s.shape[1] - self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(s >= bar[:, None])
        score = s[i, j]
        ok = np.isfinite(score)
        i, j, score = i[ok], j[ok], score[ok]
        self.kept.append((i + at, d["id"][j], d["known"][j], score))
        self.pending += len(i)
        if self.pending > self.limit:
            self.merge()

    def merge(self) -> None:
        q, did, known, s = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((did, ~known, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = (x[place < self.k] for x in (order, q, place))
        self.kept = [(q, did[order], known[order], s[order])]
        last = place == self.k - 1
        self.bar[q[last]] = s[order][last]
        self.pending = len(q)

    def result(self) -> tuple:
        self.merge()
        q, did, known, s = self.kept[0]
        return q, {"did": pa.array(did, mask=~known), "score": pa.array(s)}


class _Statistic:
    """The best score (``best``) or the number of scores above the threshold of every query."""

    def __init__(self, rows: np.ndarray, best: bool):
        self.rows, self.best = rows, best
        self.value = np.full(len(rows), -np.inf if best else 0.0)

    def add(self, at: int, s: np.ndarray, d: np.ndarray) -> None:
        q, value = self.rows[at:at + len(s)], self.value[at:at + len(s)]
        if self.best:
            same = (q["lab"][:, None] == d["lab"][None, :]) & q["labelled"][:, None] & d["labelled"][None, :]
            np.maximum(value, np.where(same & ~np.isnan(s), s, -np.inf).max(axis=1), out=value)
        else:
            value += (s > q["thr"][:, None] + TIE_EPS).sum(axis=1)

    def result(self) -> tuple:
        ok = np.flatnonzero(np.isfinite(self.value))
        return ok, {"value": pa.array(self.value[ok])}


def _compare(mode: str, k: int, exclude_self: bool, dim: int):
    """Scores of the pairs of blocks of a task, 512 queries at a time; of every block of queries
    only its best or its statistic is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        size = 0

        def done():
            for rows, groups, found, _ in held.values():
                at, columns = found.result()
                q = rows[at]
                for lo in range(0, len(at), 1 << 16):
                    part = q[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(groups, pa.string()).take(pa.array(part["g"])), pa.array(part["id"], mask=~part["known"]),
                         *(c.slice(lo, 1 << 16) for c in columns.values())], ["_g", "qid", *columns])

        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
                name = x["q_block"].as_py()
                if name not in held:
                    if size >= 2 * HELD_QUERIES:
                        yield from done()
                        held.clear()
                        size = 0
                    rows = np.frombuffer(x["q_rows"].as_buffer(), _ROW).copy()
                    groups = x["q_groups"].as_py()
                    held[name] = (rows, groups, _Best(len(rows), k) if mode == "topk" else _Statistic(
                        rows, mode == "best_relevant"), _lengths(rows, len(groups)))
                    size += len(rows)
                q, groups, found, length = held[name]
                d = np.frombuffer(x["d_rows"].as_buffer(), _ROW)
                qv, dv = (np.frombuffer(x[c].as_buffer(), np.float64).reshape(-1, dim) for c in ("q_vecs", "d_vecs"))
                number = {g: n for n, g in enumerate(groups)}
                d_groups = x["d_groups"].as_py()
                code = np.array([number.get(g, -1) for g in d_groups])
                other = _lengths(d, len(d_groups))
                if ((code >= 0) & (other >= 0) & (length[code] >= 0) & (other != length[code])).any():
                    raise ValueError("vectors of several lengths in a group")
                of = code[d["g"]]
                one = len(groups) == 1 and (of == 0).all()
                own = np.flatnonzero(np.isin(q["id"], d["id"]) & q["known"]) if exclude_self else ()
                for at in range(0, len(q), 512):
                    s = qv[at:at + 512] @ dv.T
                    if not one:
                        s[q["g"][at:at + 512, None] != of[None, :]] = -np.inf
                    for r in own:
                        if at <= r < at + 512:
                            s[r - at, (d["id"] == q["id"][r]) & d["known"]] = -np.inf
                    found.add(at, s, d)
        yield from done()

    return run


def block_pairs(queries: DataFrame, corpus: DataFrame, mode: str = "topk", k: int = 10,
                group: Sequence[str] = (), exclude_self: bool = False,
                block_q: int = BLOCK_Q, block_d: int = BLOCK_D) -> DataFrame:
    """All (query, document) cosine scores, reduced per query in the task of its block.

    ``queries``: group.., qid, vec [, lab, thr]; ``corpus``: group.., did, vec [, lab].
    mode ``topk`` -> (group.., qid, did, score) the k best of the documents a task saw;
    ``best_relevant`` -> (group.., qid, value) max score over same-``lab`` docs;
    ``count_above`` -> (group.., qid, value) docs scoring strictly above ``thr``.
    Both sides are packed into blocks of unit vectors and checkpointed, which moves every row
    once. A task takes some blocks of queries and reads the corpus block by block from the
    checkpoint (a Cartesian product of partitions), so nothing is copied through a shuffle.
    """
    g = list(group)
    seen = F.count(F.lit(1)), F.max(F.when(F.col("vec").isNotNull(), F.size("vec")))
    (nq, dim_q), (nd, dim_d) = (df.agg(*seen).first() for df in (queries, corpus))
    dim = max(dim_q or 0, dim_d or 0)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(nq / HELD_QUERIES), min(3 * cores, math.ceil(nq / block_q)))
    reads = max(1, math.ceil(nd * dim / CORPUS_NUMBERS))
    qs = _blocks(queries, "qid", g, tasks, block_q, dim, "q")
    ds = _blocks(corpus, "did", g, reads, block_d, dim, "d")
    near = (F.col("q_lo") <= F.col("d_hi")) & (F.col("d_lo") <= F.col("q_hi"))
    pairs = qs.join(ds.hint("shuffle_replicate_nl"), near)
    pairs = pairs.select("q_block", "q_groups", "q_rows", "q_vecs", "d_groups", "d_rows", "d_vecs").coalesce(tasks)
    value = "did bigint, score double" if mode == "topk" else "value double"
    out = pairs.mapInArrow(_compare(mode, k, exclude_self, dim), f"_g string, qid bigint, {value}")
    rest = out.columns[1:]
    kinds = T.StructType([f for f in queries.schema.fields if f.name in g])
    keys = F.from_json("_g", kinds) if g else None
    return out.select(*[keys[c].alias(c) for c in g], *rest)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, group: Sequence[str] = (),
          exclude_self: bool = False, **kw) -> DataFrame:
    """The k best documents per query, ties by document id; rank 1..k.

    Per query at most k candidates per task survive the block step, so the final
    window sorts a bounded group.
    """
    cand = block_pairs(queries, corpus, "topk", k, group, exclude_self, **kw)
    w = Window.partitionBy(*group, "qid").orderBy(F.desc("score"), F.asc("did"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_relevant(queries: DataFrame, corpus: DataFrame, group: Sequence[str] = (),
                  exclude_self: bool = False, **kw) -> DataFrame:
    """Best score among relevant (same ``lab``) documents per query."""
    part = block_pairs(queries, corpus, "best_relevant", 0, group, exclude_self, **kw)
    return part.groupBy(*group, "qid").agg(F.max("value").alias("best_relevant"))


def global_rank(queries: DataFrame, corpus: DataFrame, group: Sequence[str] = (),
                exclude_self: bool = False, **kw) -> DataFrame:
    """I4: 1 + number of documents scoring strictly above the best relevant one."""
    best = cut_lineage(best_relevant(queries, corpus, group, exclude_self, **kw))  # read three times below
    q = queries.join(best, [*group, "qid"]).withColumn("thr", F.col("best_relevant"))
    above = block_pairs(q.drop("best_relevant"), corpus, "count_above", 0, group,
                        exclude_self, **kw)
    counts = above.groupBy(*group, "qid").agg(F.sum("value").cast("bigint").alias("_above"))
    return (best.join(counts, [*group, "qid"])
            .select(*group, "qid", "best_relevant", (F.col("_above") + 1).alias("rank")))
