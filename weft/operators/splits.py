"""Split construction and statistics.

Everything runs for all categories at once, keyed by the category column:
cluster summaries, the hold-out choice, the grouped split search over many
seeds, and the permutation test are aggregations over (seed or
permutation, category) keys; no Python loop over categories or seeds.
Randomness is SHA-256 of (seed, key), identical in Spark and DuckDB, so the
method equals the reference's while the drawn numbers differ.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.vectors import as_double, cosine, mean_vector, top_k
from weft.session import cut_lineage, spread

# Centroid tables are collected and broadcast each k-means round; refuse
# sizes beyond this many floats (categories x restarts x k x dim).
MAX_CENTROID_FLOATS = 50_000_000
MAX_CENTROIDS = 100_000


def _hash_unit(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def isolation(centroids: DataFrame, group: Sequence[str], cluster: str) -> DataFrame:
    """H8: (group.., cluster, isolation): 1 - the largest cosine of a centroid (``mean``) to
    another one of its group; by blocks, so the centroids may be many."""
    side = centroids.select(*group, F.col(cluster).cast("bigint").alias("qid"), F.col("mean").alias("vec"))
    best = top_k(side, side.withColumnRenamed("qid", "did"), 1, group, exclude_self=True)
    kind = centroids.schema[cluster].dataType
    return best.select(*group, F.col("qid").cast(kind).alias(cluster), (1 - F.col("score")).alias("isolation"))


def cluster_summary(df: DataFrame, cat: str, cluster: str, vec: str) -> DataFrame:
    """Rows, share of the category, and isolation (1 - max cosine to
    another centroid of the same category) per (category, cluster)."""
    sizes = df.groupBy(cat, cluster).agg(F.count(F.lit(1)).alias("rows"))
    share = sizes.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(cat)))
    cents = mean_vector(df, [cat, cluster], vec)
    return share.join(isolation(cents, [cat], cluster), [cat, cluster], "left")


def cluster_holdout(summary: DataFrame, cat: str, cluster: str, lo: float = 0.10,
                    hi: float = 0.30, target: float = 0.20) -> DataFrame:
    """Per category, among clusters with lo <= share <= hi the most
    isolated, then closest to target, then lowest id; when none is
    eligible, the closest to target, then most isolated, then lowest id."""
    elig = ((F.col("share") >= lo) & (F.col("share") <= hi)).cast("int")
    s = summary.withColumn("_e", elig).withColumn("_dev", F.abs(F.col("share") - target))
    s = s.withColumn("_has", F.max("_e").over(Window.partitionBy(cat)))  # clusters of one category
    k1 = F.when(F.col("_has") == 1, -F.col("isolation")).otherwise(F.col("_dev"))
    k2 = F.when(F.col("_has") == 1, F.col("_dev")).otherwise(-F.col("isolation"))
    w = Window.partitionBy(cat).orderBy(F.desc("_e"), k1, k2, F.col(cluster))
    return (s.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
            .select(cat, cluster, "rows", "share", "isolation"))


def marginals(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Share of every value of every dimension (dimension, value, p), in one
    scan. Shares are of all rows; NULL is no value, so it takes its share away."""
    return marginals_of(df.withColumn("_n", F.lit(1)), dims)


def marginals_of(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``marginals`` of rows that stand for ``_n`` rows each."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    u = df.select("_n", F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("dimension"))
    return u.withColumn("p", F.col("_n") / total).where(F.col("value").isNotNull()).drop("_n")


def total_variation(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """0.5 * sum |p - q| per key over the union of values."""
    k = list(keys)
    j = (left.withColumnRenamed("p", "_p").join(right.withColumnRenamed("p", "_q"), [*k, "value"], "full_outer")
         .na.fill(0.0, ["_p", "_q"]))
    return j.groupBy(*k).agg((0.5 * F.sum(F.abs(F.col("_p") - F.col("_q")))).alias("tv"))


#: hash values are the first 60 bits of SHA-256
_BITS = 60
#: (category, draw) limits, some 20 bytes each, sent to every executor at most
MAX_BROADCAST_DRAWS = 1 << 20


def _draw_bits(draws: int, seed: str | None):
    """For each key the draws that take it for sure (a bit each) and, as (draw, hash), those
    whose hash lies in the bracket of its category. A hash is made once per key and draw."""
    lead = "" if seed is None else f"{seed}:"
    heads = [f"{lead}{d}:".encode() for d in range(draws)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, low, high = (part.column(c).to_pylist() for c in ("_k", "_lo", "_hi"))
                sure, near = [], []
                for k, lo, hi in zip(keys, low, high, strict=True):
                    if k is None or lo is None:
                        sure.append(None)
                        near.append([])
                        continue
                    k = k.encode()
                    h = np.frombuffer(b"".join([sha(x + k).digest()[:8] for x in heads]), ">u8") >> np.uint64(64 - _BITS)
                    h = h.astype(np.int64)
                    sure.append(np.packbits(h < lo).tobytes())
                    some = np.flatnonzero((h >= lo) & (h <= hi))
                    near.append([{"d": d, "h": x} for d, x in zip(some.tolist(), h[some].tolist(), strict=True)])
                rest = [part.column(c) for c in part.schema.names if c not in ("_lo", "_hi")]
                names = [c for c in part.schema.names if c not in ("_lo", "_hi")]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(sure, pa.binary()),
                     pa.array(near, pa.list_(pa.struct([("d", pa.int32()), ("h", pa.int64())])))],
                    [*names, "_sure", "_near"])

    return run


def _sure_counts(draws: int):
    """Per partition and category: for each draw the keys that it takes for sure."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for c, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bits is not None:
                    n = total.setdefault(c, np.zeros(draws, np.int64))
                    n += np.unpackbits(np.frombuffer(bits, np.uint8), count=draws)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()),
                                          pa.array([n.tolist() for n in total.values()], pa.list_(pa.int64()))],
                                         ["_cat", "_sure"])

    return run


def _draw_lists(draws: int):
    """The draws of each key: the sure ones, and those of the bracket up to the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for bits, near, limits in zip(*(part.column(c).to_pylist() for c in ("_sure", "_near", "_limits")),
                                              strict=True):
                    if bits is None or limits is None:
                        out.append([])
                        continue
                    took = np.unpackbits(np.frombuffer(bits, np.uint8), count=draws).astype(bool)
                    for x in near:
                        limit = limits[x["d"]]
                        if limit is not None and x["h"] <= limit:
                            took[x["d"]] = True
                    out.append(np.flatnonzero(took).tolist())
                names = [c for c in part.schema.names if c not in ("_sure", "_near", "_limits")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.list_(pa.int32()))],
                                                 [*names, "drawn"])

    return run


def draw_keys(rows: DataFrame, sizes: DataFrame, draws: int, seed: str | None = None, spread_sd: float = 6.0) -> DataFrame:
    """``rows`` (_cat, _k and any others) with ``drawn``: the draws that take the row. A draw
    takes, in each category, the ``_m`` keys (``sizes``: _cat, _m) that come first by the
    SHA-256 of ``draw:key`` (``seed:draw:key``).

    The hashes of a draw are uniform, so its m-th of N lies within some deviations of
    m / N. Keys below that bracket are drawn, one bit each, keys above it are not; only
    those inside are ranked, a share of the keys that falls with the square root of N. If
    the limit of a draw lies outside after all, the bracket is widened, so the draws are
    exact. Each hash is made once. A key that is null is never drawn.
    """
    n = rows.where("_k IS NOT NULL").groupBy("_cat").agg(F.count(F.lit(1)).alias("_size"))
    sized = cut_lineage(n.join(sizes.select("_cat", F.least("_m", F.lit(1 << 62)).alias("_m")), "_cat"))
    kind = [f for f in rows.schema.fields]
    while True:
        q, big = F.col("_m") / F.col("_size"), F.lit(float(1 << _BITS))
        margin = spread_sd * F.sqrt(F.greatest(q * (1 - q), F.lit(0.0)) / F.col("_size")) + spread_sd ** 2 / F.col("_size")
        bounds = sized.select("_cat", "_m", F.floor(F.greatest(q - margin, F.lit(0.0)) * big).cast("long").alias("_lo"),
                              F.floor(F.least(q + margin, F.lit(1.0)) * big).cast("long").alias("_hi"))
        bounds = bounds.withColumn("_hi", F.when(F.col("_m") > 0, F.col("_hi")).otherwise(F.lit(-1)))
        few = sized.count() <= MAX_BROADCAST_DRAWS
        marked = rows.join(F.broadcast(bounds) if few else bounds, "_cat", "left").select(*rows.columns, "_lo", "_hi")
        out = T.StructType([*kind, T.StructField("_sure", T.BinaryType()), T.StructField("_near", T.ArrayType(
            T.StructType([T.StructField("d", T.IntegerType()), T.StructField("h", T.LongType())])))])
        marked = cut_lineage(spread(marked).mapInArrow(_draw_bits(draws, seed), out))
        partial = marked.select("_cat", "_sure").mapInArrow(_sure_counts(draws), "_cat string, _sure array<long>")
        sure = (partial.select("_cat", F.posexplode("_sure").alias("_d", "_n")).groupBy("_cat", "_d")
                .agg(F.sum("_n").alias("_n")))
        # how many of each draw's bracket are drawn
        wants = sized.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).join(
            sure, ["_cat", "_d"], "left").select("_cat", "_d", (F.col("_m") - F.coalesce("_n", F.lit(0))).alias("_r"))
        inside = marked.select("_cat", F.explode("_near").alias("x")).select("_cat", F.col("x.d").alias("_d"), "x.h")
        place = F.row_number().over(Window.partitionBy("_cat", "_d").orderBy("h"))
        at = (inside.withColumn("_i", place).join(wants.withColumnRenamed("_r", "_w"), ["_cat", "_d"])
              .where(F.col("_i") == F.col("_w")).select("_cat", "_d", "h"))
        limits = cut_lineage(wants.join(at, ["_cat", "_d"], "left"))
        if limits.where("_r < 0 OR (_r > 0 AND h IS NULL)").isEmpty():
            break
        spread_sd *= 4
    lists = limits.groupBy("_cat").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "h"))),
                                                   lambda x: x["h"]).alias("_limits"))
    lists = lists.withColumnRenamed("_cat", "_c")
    few = limits.count() <= MAX_BROADCAST_DRAWS
    both = marked.join(F.broadcast(lists) if few else lists, F.col("_cat").eqNullSafe(F.col("_c")), "left").drop("_c")
    return both.mapInArrow(_draw_lists(draws), T.StructType([*kind, T.StructField("drawn", T.ArrayType(T.IntegerType()))]))


def grouped_split_search(df: DataFrame, group_col: str, dims: Sequence[str], target_rows: int,
                         total_rows: int, seeds: int = 200) -> DataFrame:
    """For every seed, the first ceil(share * groups) groups in seeded
    hash order form the candidate; score = |rows - target| / total + sum
    over dims of TV(candidate, all rows); best by (score, |rows - target|,
    seed). ``share`` = target / rows, a share of groups as in a group
    shuffle split.

    The rows are aggregated once into (group, dimension values) cells and
    checkpointed. Every group is listed with the seeds that draw it (``draw_keys``), and
    one pass over the drawn cells adds counts per (seed, dimension, value).
    """
    cells = cut_lineage(df.groupBy(group_col, *dims).agg(F.count(F.lit(1)).alias("_n")))
    n_rows = cells.agg(F.sum("_n")).first()[0]
    keys = cells.select(F.lit("").alias("_cat"), F.col(group_col).cast("string").alias("_k")).distinct()
    n_valid = math.ceil((target_rows / n_rows) * keys.count())
    one = keys.sparkSession.createDataFrame([("", n_valid)], "_cat string, _m bigint")
    took = draw_keys(keys, one, seeds).select(F.col("_k"), F.explode("drawn").alias("seed"))
    drawn = cells.join(took, F.col(group_col).cast("string") == F.col("_k")).drop("_k")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims],
                    F.struct(F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("string").alias("value")))
    counts = cut_lineage(drawn.select("seed", "_n", F.explode(pairs).alias("x")).groupBy(
        "seed", "x.dimension", "x.value").agg(F.sum("_n").alias("_n")))
    size = counts.filter(F.col("dimension").isNull()).select("seed", F.col("_n").alias("valid_rows"))
    whole = marginals_of(cells, dims)
    cand = (counts.filter(F.col("dimension").isNotNull() & F.col("value").isNotNull()).join(size, "seed")
            .withColumn("p", F.col("_n") / F.col("valid_rows")).drop("_n", "valid_rows"))
    grid = whole.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    tv = total_variation(cand, grid, ["seed", "dimension"]).groupBy("seed").agg(F.sum("tv").alias("tv"))
    scored = (size.join(tv, "seed")
              .withColumn("size_error", F.abs(F.col("valid_rows") - target_rows))
              .withColumn("score", F.col("size_error") / total_rows + F.col("tv")))
    return scored.orderBy("score", "size_error", "seed").limit(1)


def assign_split(df: DataFrame, test_flag: Column, valid_flag: Column) -> Column:
    """Test, then valid, else train."""
    return F.when(test_flag, "test").when(valid_flag, "valid").otherwise("train")


def split_invariants(df: DataFrame, split_col: str, dims: Sequence[str], expected: DataFrame,
                     test_ok: Column, held: Column | None = None) -> DataFrame:
    """Violations (empty = pass): split counts differing from
    ``expected`` (split, rows); dimension values missing from a split; test
    rows outside the held-out clusters (``test_ok``); rows of other splits inside
    them (``held``)."""
    counts = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
    bad_counts = (expected.join(counts, split_col, "full_outer")
                  .filter(~F.col("expected").eqNullSafe(F.col("rows")))
                  .select(F.lit("split_count").alias("check"), F.col(split_col).alias("detail")))
    names = sorted(r[0] for r in df.select(split_col).distinct().collect())  # a handful of split names
    missing = None
    for d in dims:
        vals = df.select(F.col(d).cast("string").alias("_v")).distinct()
        have = df.select(split_col, F.col(d).cast("string").alias("_v")).distinct()
        want = vals.withColumn(split_col, F.explode(F.array(*[F.lit(n) for n in names])))
        miss = (want.join(have, [split_col, "_v"], "left_anti")
                .select(F.lit(f"missing_{d}").alias("check"),
                        F.concat_ws("=", F.col(split_col), F.col("_v")).alias("detail")))
        missing = miss if missing is None else missing.unionByName(miss)
    bad_test = (df.filter((F.col(split_col) == "test") & ~test_ok)
                .select(F.lit("test_outside_holdout").alias("check"), F.lit("row").alias("detail")))
    out = bad_counts.unionByName(missing).unionByName(bad_test)
    if held is not None:
        out = out.unionByName(df.filter((F.col(split_col) != "test") & held).select(
            F.lit("holdout_outside_test").alias("check"), F.col(split_col).alias("detail")))
    return out


def _perm_partials(n_perm: int):
    """Per partition and category: sums of the held-out rows, of all rows,
    and of each permutation's selected rows (each row lists the
    permutations that select it)."""
    def run(it):
        acc: dict = {}
        for pdf in it:
            for c, g in pdf.groupby("_cat", sort=False):
                x = np.stack(g["_v"].to_numpy())
                m = acc.get(c)
                if m is None:
                    m = acc[c] = np.zeros((n_perm + 2, x.shape[1]))
                held = g["_held"].to_numpy().astype(bool)
                m[0] += x[held].sum(axis=0)
                m[1] += x.sum(axis=0)
                lists = g["perms"].to_numpy()
                for lo in range(0, len(x), 1024):  # permutations x rows, as a 0/1 matrix
                    drawn = np.zeros((n_perm, len(x[lo:lo + 1024])))
                    for j, p in enumerate(lists[lo:lo + 1024]):
                        if p is not None and len(p):
                            drawn[np.asarray(p, dtype=int), j] = 1.0
                    m[2:] += drawn @ x[lo:lo + 1024]
        out = [(c, i - 2, m[i].tolist()) for c, m in acc.items() for i in range(m.shape[0])]
        yield pd.DataFrame(out, columns=["_cat", "perm", "s"])
    return run


_PERM_SCHEMA = T.StructType([T.StructField("_cat", T.StringType()), T.StructField("perm", T.IntegerType()),
                             T.StructField("s", T.ArrayType(T.DoubleType()))])


def permutation_test(df: DataFrame, cat: str, key: str, vec: str, held: str, n_perm: int,
                     seed: int = 0) -> DataFrame:
    """observed = mean over categories of the cosine distance between
    the mean vectors of held-out and other rows; each permutation picks, per
    category, as many rows as are held out (smallest seeded hashes).

    Every row lists the permutations that draw it (``draw_keys``), in place, and every
    partition adds its vectors into per-(category, permutation) sums,
    emitting only those partial sums. Means matter only up to scale, so sums are
    compared: selected against total minus selected.
    """
    # read by three passes (sizes, limits, sums): materialized once
    d = cut_lineage(df.select(F.col(cat).cast("string").alias("_cat"), F.col(key).cast("string").alias("_k"),
                              as_double(vec).alias("_v"), F.col(held).cast("boolean").alias("_held")))
    sizes = d.groupBy("_cat").agg(F.count_if("_held").alias("_m"))
    rows = draw_keys(d, sizes, n_perm, str(seed)).withColumnRenamed("drawn", "perms")

    def red(pdf: pd.DataFrame) -> pd.DataFrame:
        perm, at = np.unique(pdf["perm"].to_numpy(), return_inverse=True)
        v = np.stack(pdf["s"].to_numpy())
        total = np.zeros((len(perm), v.shape[1]))
        np.add.at(total, at, v)
        return pd.DataFrame({"_cat": pdf["_cat"].iloc[0], "perm": perm, "s": list(total)})

    # a group holds 256 permutations of a category: one short vector for each and partition
    sums = (rows.mapInPandas(_perm_partials(n_perm), _PERM_SCHEMA)
            .groupBy("_cat", F.floor(F.col("perm") / 256)).applyInPandas(lambda pdf: red(pdf), _PERM_SCHEMA))
    sums = cut_lineage(sums)  # read by three branches
    tot = sums.filter(F.col("perm") == -1).select("_cat", F.col("s").alias("_t"))
    sel = sums.filter(F.col("perm") != -1).join(tot, "_cat")
    rest = F.zip_with("_t", "s", lambda t, x: t - x)
    dist = sel.select("_cat", "perm", (1 - cosine(F.col("s"), rest)).alias("_d"))
    obs = dist.filter(F.col("perm") == -2).agg(F.avg("_d").alias("observed_shift"))
    per = dist.filter(F.col("perm") >= 0).groupBy("perm").agg(F.avg("_d").alias("_shift"))
    return (per.crossJoin(obs)  # one-row observed table
            .agg(F.first("observed_shift").alias("observed_shift"),
                 F.avg("_shift").alias("random_mean"),
                 F.count(F.lit(1)).alias("permutations"),
                 F.sum((F.col("_shift") >= F.col("observed_shift")).cast("int")).alias("_ge"))
            .select("observed_shift", "random_mean",
                    (F.col("observed_shift") / F.col("random_mean")).alias("effect_ratio"),
                    ((F.col("_ge") + 1) / (F.col("permutations") + 1)).alias("p_value"), "permutations"))


# ------------------------------------------------------------------ k-means

def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids; one product, as no difference is kept per pair."""
    d2 = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]
    return np.maximum(d2, 0.0)


def _kmeans_partials(shared):
    def run(it):
        cents = shared.value
        for pdf in it:
            rows = []
            for c, g in pdf.groupby("_cat", sort=False):
                cc = cents.get(c)
                if cc is None:
                    continue
                x = np.stack(g["_v"].to_numpy())  # rows of this category in this batch
                for r, centroids in cc.items():
                    k = len(centroids)
                    lab = _squares(x, centroids).argmin(axis=1)
                    best = ((x - centroids[lab]) ** 2).sum(axis=1)
                    for j in range(k):
                        m = lab == j
                        if m.any():
                            rows.append((c, r, j, int(m.sum()), float(best[m].sum()), x[m].sum(axis=0).tolist()))
            yield pd.DataFrame(rows, columns=["_cat", "restart", "cluster", "n", "inertia", "s"])
    return run


_PART_SCHEMA = T.StructType([
    T.StructField("_cat", T.StringType()), T.StructField("restart", T.IntegerType()),
    T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("inertia", T.DoubleType()), T.StructField("s", T.ArrayType(T.DoubleType()))])


def _reduce_partials(parts: DataFrame) -> DataFrame:
    def red(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(pdf["s"].to_numpy()).sum(axis=0)
        return pd.DataFrame([(pdf["_cat"].iloc[0], int(pdf["restart"].iloc[0]), int(pdf["cluster"].iloc[0]),
                              int(pdf["n"].sum()), float(pdf["inertia"].sum()), s.tolist())],
                            columns=list(pdf.columns))
    return parts.groupBy("_cat", "restart", "cluster").applyInPandas(red, _PART_SCHEMA)


_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer on uint64 arrays (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_SEED_SCHEMA = T.StructType([
    T.StructField("_cat", T.StringType()), T.StructField("restart", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("_v", T.ArrayType(T.DoubleType()))])


def _seed_round(shared, restarts: int, rnd: int, seed: int):
    """One k-means++ draw per (category, restart): weighted reservoir key
    log(u) / D^2 (D = distance to the nearest chosen centroid, 1 when none),
    best key per partition; a later max picks the global draw."""
    def run(it):
        chosen = shared.value
        for pdf in it:
            rows = []
            for c, g in pdf.groupby("_cat", sort=False):
                x = np.stack(g["_v"].to_numpy())
                h0 = g["_kh"].to_numpy().astype(np.uint64)
                for r in range(restarts):
                    u = (_mix64(h0 ^ _mix64(np.full(len(h0), seed * 1_000_003 + r * 1009 + rnd, np.uint64)))
                         >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                    u = np.clip(u, 1e-300, 1.0)
                    cc = chosen.get((c, r))
                    d2 = np.ones(len(x)) if cc is None else ((x[:, None, :] - cc[None]) ** 2).sum(axis=2).min(axis=1)
                    with np.errstate(divide="ignore"):
                        key = np.where(d2 > 0, np.log(u) / d2, -np.inf)
                    i = int(np.argmax(key))
                    if np.isfinite(key[i]):
                        rows.append((c, r, float(key[i]), x[i].tolist()))
            yield pd.DataFrame(rows, columns=["_cat", "restart", "score", "_v"])
    return run


def _kmeanspp_seed(d: DataFrame, k: int, restarts: int, seed: int) -> dict:
    """k-means++ seeding for every (category, restart) at once: k passes,
    each keeping one candidate per partition and group (bounded)."""
    spark = d.sparkSession
    dk = d.withColumn("_kh", F.xxhash64(F.col("_key").cast("string")))
    chosen: dict = {}
    for rnd in range(k):
        bc = spark.sparkContext.broadcast(chosen)
        cand = dk.mapInPandas(_seed_round(bc, restarts, rnd, seed), _SEED_SCHEMA)
        best = cand.groupBy("_cat", "restart").agg(F.max_by("_v", "score").alias("_v")).collect()
        bc.unpersist()
        if best:
            dim = len(best[0]["_v"])
            n_cats = len({r["_cat"] for r in best})
            if n_cats * restarts * k * dim > MAX_CENTROID_FLOATS:
                raise ValueError("centroid table too large to broadcast; use fewer categories or restarts")
        for r in best:
            v = np.asarray(r["_v"])[None, :]
            key = (r["_cat"], r["restart"])
            chosen[key] = v if key not in chosen else np.vstack([chosen[key], v])
    cents: dict = {}
    for (c, r), v in chosen.items():
        arr = cents.setdefault(c, np.zeros((restarts, k, v.shape[1])))
        arr[r, :len(v)] = v
        arr[r, len(v):] = v[-1]  # fewer distinct points than k: repeat the last
    return cents


def lloyd_step(df: DataFrame, cat: str, vec: str, centroids: DataFrame) -> DataFrame:
    """H10, one round on its own: (_cat, restart, cluster, n, inertia, s) from given
    ``centroids`` (cat, cluster, vec): every row goes to the nearest (ties to the lower
    cluster); ``s`` are the sums of the rows, ``inertia`` their squared distances."""
    rows = centroids.select(F.col(cat).cast("string").alias("c"), "cluster", as_double(vec).alias("v")).sort("c", "cluster")
    found = rows.limit(MAX_CENTROIDS + 1).collect()
    if len(found) > MAX_CENTROIDS:
        raise ValueError("centroid table too large to send to every executor")
    table: dict = {}
    for r in found:
        table.setdefault(r.c, []).append(r.v)
    shared = df.sparkSession.sparkContext.broadcast({c: {0: np.array(v)} for c, v in table.items()})
    d = df.select(F.col(cat).cast("string").alias("_cat"), as_double(vec).alias("_v"))
    return _reduce_partials(d.mapInPandas(_kmeans_partials(shared), _PART_SCHEMA))


def _unit_means(df: DataFrame, cat: str, group: str, vec: str) -> DataFrame:
    """(_cat, _group, _v): the mean vector of each group, at unit length."""
    parts = df.select(F.col(cat).cast("string").alias("_cat"), F.col(group).alias("_group"),
                      F.posexplode(as_double(vec)).alias("_pos", "_x"))
    mean = parts.groupBy("_cat", "_group", "_pos").agg(F.avg("_x").alias("_x"))
    whole = mean.groupBy("_cat", "_group").agg(F.sort_array(F.collect_list(F.struct("_pos", "_x")))["_x"].alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    whole = whole.withColumn("_n", norm)
    return whole.select("_cat", "_group", F.when(
        F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v")).alias("_v"))


def grouped_kmeans(df: DataFrame, cat: str, key: str, vec: str, k: int = 5, restarts: int = 20,
                   iters: int = 300, seed: int = 0, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K-means inside every category at once, ``restarts`` k-means++
    seeded starts, Lloyd rounds until the centroids of a (category, restart) no
    longer move (``iters`` rounds at most, 300 as in the reference's library); the
    restart with the lowest inertia wins per category. With ``group``, the unit
    means of the rows of each group are clustered and rows inherit their group's
    cluster. Returns (rows with ``cluster``, per (category, restart) inertia).

    Each round: centroids (categories x restarts x k, size-checked) are
    broadcast; every partition emits partial sums per (category, restart,
    cluster); a keyed reduce gives the new centroids. Rows never move.
    """
    spark = df.sparkSession
    if group is not None:
        means = cut_lineage(_unit_means(df, cat, group, vec))
        found, inert = grouped_kmeans(means, "_cat", "_group", "_v", k, restarts, iters, seed)
        of = found.select(F.col("_cat").alias("_of_cat"), F.col("_group").alias("_of_group"), "cluster")
        same = F.col(cat).cast("string").eqNullSafe(F.col("_of_cat")) & F.col(group).eqNullSafe(F.col("_of_group"))
        return df.join(of, same, "left").drop("_of_cat", "_of_group"), inert.withColumnRenamed("_cat", cat)
    d = df.select(F.col(cat).cast("string").alias("_cat"), F.col(key).alias("_key"),
                  as_double(vec).alias("_v"))
    cents = _kmeanspp_seed(d, k, restarts, seed)
    inertia: dict = {}
    moving = {(c, r) for c in cents for r in range(restarts)}
    for _ in range(iters):
        if not moving:
            break
        active: dict = {}
        for c, r in sorted(moving):
            active.setdefault(c, {})[r] = cents[c][r]
        bc = spark.sparkContext.broadcast(active)
        parts = _reduce_partials(d.mapInPandas(_kmeans_partials(bc), _PART_SCHEMA))
        got = parts.collect()  # categories x restarts x k rows
        new = {c: v.copy() for c, v in cents.items()}
        inertia |= dict.fromkeys(moving, 0.0)
        for r in got:
            new[r["_cat"]][r["restart"], r["cluster"]] = np.asarray(r["s"]) / r["n"]
            inertia[(r["_cat"], r["restart"])] += r["inertia"]
        # sums of another order differ in their last bits
        moving = {(c, r) for c, r in moving if not np.allclose(new[c][r], cents[c][r], rtol=1e-9, atol=1e-12)}
        cents = new
        bc.unpersist()
    inert = spark.createDataFrame([(c, int(r), float(v)) for (c, r), v in inertia.items()],
                                  "_cat string, restart int, inertia double")
    best = inert.withColumn("_rk", F.row_number().over(
        Window.partitionBy("_cat").orderBy("inertia", "restart"))).filter("_rk = 1")
    best_restart = {r["_cat"]: r["restart"] for r in best.collect()}
    final = {c: cents[c][best_restart[c]] for c in best_restart}
    bc = spark.sparkContext.broadcast(final)

    @F.pandas_udf(T.IntegerType())
    def assign(c: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(c), np.int32)
        for ci, at in c.groupby(c, sort=False).indices.items():  # one product per category of the batch
            out[at] = _squares(np.stack(v.iloc[at].to_numpy()), bc.value[ci]).argmin(axis=1)
        return pd.Series(out)

    labelled = df.withColumn("cluster", assign(F.col(cat).cast("string"), as_double(vec)))
    return labelled, inert.withColumnRenamed("_cat", cat)
