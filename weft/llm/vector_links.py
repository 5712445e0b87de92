"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Only vectors with the same label are compared. Equal vectors are one class. The
classes of a label are sorted by their first projection and cut into tiles of
at most ``tile`` classes; two tiles meet only if the first projection lets them
hold a pair within the threshold (a unit direction never stretches a distance,
so this loses nothing). Within a pair of tiles every projection is sorted, the
window around each query's own value is cut out of the sorted order, and a pair
is counted once for every window it falls in. Near pairs fall into almost all
windows; the count that a pair must reach is calibrated so that a pair exactly
at the threshold misses it with probability ``miss`` at most. Pairs that reach it
are verified by their cosine in double precision. A task holds one pair of tiles
and returns link counts and a spanning set of its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.common import kept

TILE = 1024


def projection_matrix(dim: int, m: int, seed: int = 7) -> np.ndarray:
    """m random unit directions as columns."""
    a = np.random.default_rng(seed).standard_normal((dim, m))
    return a / np.linalg.norm(a, axis=0)


def calibrate(m: int, dim: int, miss: float, width: float = 1.5) -> tuple[float, int]:
    """(half window in units of the pair's distance / sqrt(dim), least count).

    A pair at distance d differs by about N(0, d / sqrt(dim)) along a random unit
    direction, so it falls into a window of ``width`` deviations with a known
    probability p, and its count is binomial (m, p). Closer pairs count more."""
    p = math.erf(width / math.sqrt(2))
    p -= 0.02  # directions are few-dimensional, not Gaussian: leave room
    below, count = 0.0, 0
    while count < m:
        below += math.comb(m, count) * p ** count * (1 - p) ** (m - count)
        if below > miss:
            break
        count += 1
    return width, count


def unit_rows(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(rows, np.float64)
    return x, np.sqrt((x * x).sum(axis=1))


def window_counts(q: np.ndarray, x: np.ndarray, half: float) -> np.ndarray:
    """Collisions of every query (rows of ``q``) with every row of ``x``: the number
    of projections (columns) in which x lies in the window around the query."""
    out = np.zeros((len(q), len(x)), np.uint8)
    for j in range(q.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        values = x[order, j]
        lo = np.searchsorted(values, q[:, j] - half, side="left")
        hi = np.searchsorted(values, q[:, j] + half, side="right")
        place = np.empty(len(x), np.int32)
        place[order] = np.arange(len(x), dtype=np.int32)
        out += ((place >= lo[:, None].astype(np.int32)) & (place < hi[:, None].astype(np.int32)))
    return out


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the pairs (a, b) connect: fewer than n."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _tile_pair(threshold: float, m: int, miss: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        two = rows["side"].to_numpy()
        groups = [rows[two == 0], rows[two == 1]] if (two == 1).any() else [rows]
        if int(rows["tiles"].iloc[0]) == 2 and len(groups) == 1:
            groups = [rows, rows.iloc[:0]]
        same = len(groups) == 1
        q, x = groups[0], groups[-1]
        links_q, links_x = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
        edges = []
        if len(q) and len(x):
            vq, nq = unit_rows(q["v"].tolist())
            vx, nx = (vq, nq) if same else unit_rows(x["v"].tolist())
            uq, ux = vq / nq[:, None], vx / nx[:, None]
            a = projection_matrix(uq.shape[1], m)
            width, least = calibrate(m, uq.shape[1], miss)
            half = width * math.sqrt(2 * (1 - threshold)) / math.sqrt(uq.shape[1]) + 1e-9
            i, j = np.nonzero(window_counts(uq @ a, ux @ a, half) >= least)
            if same:
                i, j = i[i < j], j[i < j]
            keep = [np.zeros(0, bool)]
            for c in range(0, len(i), 1 << 18):
                ii, jj = i[c:c + (1 << 18)], j[c:c + (1 << 18)]
                keep.append((vq[ii] * vx[jj]).sum(axis=1) / (nq[ii] * nx[jj]) >= threshold)
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
            np.add.at(links_q, i, x["copies"].to_numpy()[j])
            np.add.at(links_q if same else links_x, j, q["copies"].to_numpy()[i])
            off = 0 if same else len(q)
            both = np.concatenate([q["key"].to_numpy(), x["key"].to_numpy()])
            edges = [(both[s], both[t]) for s, t in spanning(len(q) + len(x), i, j + off)]
        keys = q["key"].to_numpy() if same else np.concatenate([q["key"].to_numpy(), x["key"].to_numpy()])
        links = links_q if same else np.concatenate([links_q, links_x])
        some = links > 0
        return pd.DataFrame({
            "a": pd.Series([*keys[some], *(e[0] for e in edges)], dtype=object),
            "b": pd.Series([*[None] * int(some.sum()), *(e[1] for e in edges)], dtype=object),
            "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)]).astype(np.int64)})

    return run


def vector_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", m: int = 48, miss: float = 1e-6, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of the same label whose cosine is
    at least ``threshold`` are linked.

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, as does one without a label; vectors of different lengths
    are never linked. Repeated rows of one id count as separate vectors, with a row
    each. Vectors are scaled before they are squared, so none is too small or too
    large. Rows with a null id are returned as they are, unlinked. Other columns are ignored. An
    empty table gives no rows.
    """
    v = F.col("v")
    good = (F.col("label").isNotNull() & F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
            & F.exists(v, lambda e: e != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label")).withColumn("good", F.coalesce(good, F.lit(False)))
    usable = rows.where("good").withColumn("v", F.transform("v", lambda e: e + F.lit(0.0)))
    # class = equal vectors of a label, named by a 128-bit key (an id may stand for several vectors)
    bits = F.concat_ws(",", F.transform("v", lambda e: e.cast("string")))
    usable = usable.withColumn("key", F.md5(F.concat_ws("|", F.size("v"), F.to_json(F.struct("label")), bits)))
    # powers of two keep every digit and bring squares that would over- or underflow into range
    most = F.array_max(F.transform("v", lambda e: F.abs(e)))
    factor = F.when(most < 2.0 ** -400, 2.0 ** 600).when(most > 2.0 ** 400, 2.0 ** -600).otherwise(1.0)
    usable = usable.withColumn("factor", factor).withColumn("v", F.transform("v", lambda e: e * F.col("factor")))
    members = kept(usable.select("id", "label", "key", "v"), "vector-members")
    classes = members.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"),
                                         F.first("label").alias("label"), F.first("v").alias("v"))

    # tiles: classes in the order of their first projection, within (label, length)
    classes = classes.withColumn("dim", F.size("v"))
    dims = [r[0] for r in classes.select("dim").distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("vectors of more than 1000 different lengths")
    first = F.lit(0.0)
    for d in dims:
        w = projection_matrix(d, 1)[:, 0].tolist()
        dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in w]), lambda a, b: a * b), F.lit(0.0),
                          lambda s, e: s + e)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
        first = F.when(F.col("dim") == d, dot / norm).otherwise(first)
    classes = kept(classes.withColumn("p", first), "vector-classes")
    tiled = tiles(classes, tile)
    spans = tiled.groupBy("label", "dim", "tile").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    spans = kept(spans, "vector-tiles")
    reach = math.sqrt(max(0.0, 2 * (1 - threshold))) + 1e-9
    s, t = spans.alias("s"), spans.alias("t")
    meet = s.join(t, (F.col("s.label") == F.col("t.label")) & (F.col("s.dim") == F.col("t.dim"))
                  & (F.col("s.tile") <= F.col("t.tile")) & (F.col("t.lo") <= F.col("s.hi") + reach))
    meet = meet.select(F.col("s.label").alias("label"), F.col("s.dim").alias("dim"), F.col("s.tile").alias("one"),
                       F.col("t.tile").alias("two"))
    sides = meet.select("label", "dim", "one", "two", F.explode(F.when(
        F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("tile"), F.lit(0).alias("side"))))
        .otherwise(F.array(F.struct(F.col("one").alias("tile"), F.lit(0).alias("side")),
                           F.struct(F.col("two").alias("tile"), F.lit(1).alias("side"))))).alias("s"))
    sides = sides.select("label", "dim", "one", "two", "s.tile", "s.side",
                         (F.when(F.col("one") == F.col("two"), 1).otherwise(2)).alias("tiles"))
    work = tiled.join(sides, ["label", "dim", "tile"]).select("label", "dim", "one", "two", "side", "tiles", "key",
                                                              "copies", "v")
    found = work.groupBy("label", "dim", "one", "two").applyInPandas(
        _tile_pair(threshold, m, miss), "a string, b string, links long")
    found = kept(found, "vector-links")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "key")
    of_class = classes.select("key", "rep", "copies").join(degree, "key", "left").join(comp, "key", "left")
    of_class = of_class.select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                               F.coalesce("component", "key").alias("component"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "component").select("key", "n_links", "component_id")
    linked = members.select("id", "key").join(of_class, "key").select("id", "n_links", "component_id")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def tiles(classes: DataFrame, tile: int) -> DataFrame:
    """Add ``tile``: runs of at most ``tile`` rows in the order of p within (label, dim).

    A coarse histogram per label gives each bin's rank range; only bins are
    numbered over a label, rows are numbered within their bin, and a bin wider
    than a tile is cut by the row's number. No task holds a whole label."""
    bins = classes.withColumn("bin", F.floor(F.col("p") * 4096).cast("long"))
    counts = bins.groupBy("label", "dim", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    inside = Window.partitionBy("label", "dim", "bin").orderBy("p", "key")
    ranked = bins.withColumn("r", F.row_number().over(inside) - 1).join(counts, ["label", "dim", "bin"])
    return ranked.withColumn("tile", F.floor((F.col("before") + F.col("r")) / tile).cast("long")).drop(
        "bin", "n", "before", "r")
