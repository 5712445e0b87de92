"""Similarity join of documents by the Jaccard similarity of their word n-grams.

Documents with equal n-gram sets are one class; classes are joined, copies are
never compared with each other.

Candidates: chosen paths. Every class has ``t`` MinHash values. A run starts with
all classes in one node. At a node, each of the t coordinates is chosen with
probability ``branch`` / t (by a hash of the node), and a class goes on to the
child (node, coordinate, value) of every chosen coordinate. A pair of similarity
s stays together in s * branch children on average, whatever else the node holds;
unlike classes part at once. Nodes of at most ``limit`` classes are leaves; larger
ones are split again, ``depth`` times at most, and a leaf that is still larger
(many alike classes) is compared in tiles of ``limit`` classes, so a task's work
is bounded. ``runs_for`` gives the number of runs that finds a pair at the
threshold with probability ``recall``. Leaves with the same members are compared
once. A comparison estimates similarities from the MinHash values and returns a
spanning set of the pairs that may reach the threshold, fewer than its members.

Links: the components of these pairs hold every found pair. Within each, all pairs
are verified exactly on the full n-gram sets, in tiles again, which gives exact link
counts and a spanning set of the links, but no row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Hashes, distinct, kept, mix, text_hash, trim, without
from weft.llm.components import components
from weft.llm.vector_links import spanning

U = np.uint64
COORDINATES = 64
#: words whose hashes a task remembers, some 150 bytes each
WORDS = 1 << 17
_KEYS = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def survival(similarity: float, branch: float, depth: int) -> float:
    """Least probability that a pair shares a leaf of one run."""
    p = 1.0
    for _ in range(depth):
        p = 1.0 - math.exp(-similarity * branch * p)
    return p


def runs_for(threshold: float, recall: float, branch: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - survival(threshold, branch, depth))))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words (of all words, if fewer)."""
    k = min(n, len(words))
    if k == 0:
        return words
    m = len(words) - k + 1
    h = np.full(m, k, U)
    for j in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[j:j + m])
    return distinct(h)


def min_hashes(values: np.ndarray) -> np.ndarray:
    """32 bits of the least hash of the set under each of the coordinates' keys."""
    out = np.full(COORDINATES, np.iinfo(U).max, U)
    for a in range(0, len(values), 4096):
        v = values[a:a + 4096]
        h = (v ^ (v >> U(29)))[None, :] * _KEYS[:, None]
        out = np.minimum(out, (h ^ (h >> U(32))).min(axis=1))
    return (out & U(0xFFFFFFFF)).astype(np.uint32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds the results of few."""
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            yield b.slice(lo, 512)


def _class_keys(n: int):
    """(who, key of the set, MinHash values) of each document; the sets themselves are not kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        hashes = Hashes(WORDS)
        for b in _slices(batches):
            keys, sigs = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(hashes.array(t.lower().split()), n)
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(min_hashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                             ["who", "key", "sig"])
        hashes.clear()
        trim()

    return run


def _sets(n: int):
    """(rep, set) of (rep, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(WORDS)
        for b in _slices(batches):
            sets = [shingle_set(hashes.array(t.lower().split()), n).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "set"])
        hashes.clear()
        trim()

    return run


def _paths(branch: float, runs: int, first: bool):
    """Children of each class at its node (at the root of every run, if first)."""
    share = branch / COORDINATES
    bar = U(min(int(share * 2.0 ** 64), 2 ** 64 - 1))
    places = np.arange(COORDINATES, dtype=U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(U)
            if first:
                nodes = mix(np.arange(1, runs + 1, dtype=U))
                reps, children = [], []
                for node in nodes:
                    for c in np.flatnonzero(mix(node + places * U(0x9E3779B97F4A7C15)) < bar):
                        children.append(mix(mix(node ^ U(c + 1)) + sig[:, c]))
                        reps.append(rep)
                reps, children = np.concatenate(reps or [rep[:0]]), np.concatenate(children or [sig[:0, 0]])
            else:
                node = b.column(2).to_numpy().view(U)
                pick = mix(node[:, None] + places * U(0x9E3779B97F4A7C15)) < bar
                i, c = np.nonzero(pick)
                reps, children = rep[i], mix(mix(node[i] ^ (c + 1).astype(U)) + sig[i, c])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(children.view(np.int64))], ["rep", "node"])

    return run


def _tiles(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """One row per member and pair of tiles it takes part in. ``rows``: group, rep,
    n (members of the group) and payload. A group of at most ``limit`` members is
    one tile; a larger one is dealt by hash into tiles, and every two of them meet."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(limit))).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", mine)
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn(
        "one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))


def _compare_signatures(least: float):
    """Spanning pairs of a leaf (or two tiles of it) whose estimate is >= ``least``."""
    need = math.ceil(least * COORDINATES)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rep = rows["rep"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, COORDINATES)
        tile = rows["tile"].to_numpy()
        one, two = rows["one"].iloc[0], rows["two"].iloc[0]
        a, z = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
        left, right = [], []
        for lo in range(0, len(a), 64):
            part = a[lo:lo + 64]
            same = np.zeros((len(part), len(z)), np.uint8)
            for c in range(COORDINATES):
                same += sig[part, c][:, None] == sig[z, c][None, :]
            i, j = np.nonzero(same >= need)
            left.append(part[i])
            right.append(z[j])
        i, j = np.concatenate(left or [a[:0]]), np.concatenate(right or [a[:0]])
        ok = i != j
        pairs = spanning(len(rep), i[ok], j[ok])
        return pd.DataFrame({"a": rep[[p[0] for p in pairs]].astype(np.int64),
                             "b": rep[[p[1] for p in pairs]].astype(np.int64)})

    return run


def _verify(threshold: float):
    """Exact links between the members of one or two tiles of a component."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        tile = rows["tile"].to_numpy()
        one, two = rows["one"].iloc[0], rows["two"].iloc[0]
        sets = [np.frombuffer(s, U) for s in rows["set"]]
        size = np.array([len(s) for s in sets])
        a, z = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
        z = z[np.argsort(size[z], kind="stable")]
        links = np.zeros(len(rep), np.int64)
        left, right = [], []
        # an inverted index of the second tile: for each distinct shingle, its members
        owner = np.repeat(np.arange(len(z)), size[z])
        value = np.concatenate([sets[i] for i in z]) if len(z) else np.zeros(0, U)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        for i in a:
            lo, hi = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(z))
            j = np.flatnonzero(common >= threshold * (size[i] + size[z] - common) - 1e-9)
            j = z[j]
            j = j[j > i] if one == two else j
            links[i] += copies[j].sum()
            links[j] += copies[i]
            left.append(np.full(len(j), i))
            right.append(j)
        i, j = np.concatenate(left or [a[:0]]), np.concatenate(right or [a[:0]])
        pairs = spanning(len(rep), i, j)
        some = links > 0
        return pd.DataFrame({
            "a": np.concatenate([rep[some], rep[[p[0] for p in pairs]]]).astype(np.int64),
            "b": np.concatenate([np.full(some.sum(), -1), rep[[p[1] for p in pairs]]]).astype(np.int64),
            "links": np.concatenate([links[some], np.zeros(len(pairs), np.int64)])})

    return run


#: rows of (id, text hash, number), some 40 bytes each, sent to every executor at most
BROADCAST_ROWS = 1 << 20


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def classes_of(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (row, id, th, key) of every document, and the classes of equal
    n-gram sets as (rep, id, th, key, copies, sig). ``rep`` is the least row number;
    (id, th) is that document's id and text hash, by which its text is found again."""
    view = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                                text_hash(text_col).alias("th")).alias("who"), _text(text_col).alias("text"))
    keyed = kept(view.mapInArrow(_class_keys(n), "who struct<row:long,id:long,th:long>, key binary, sig binary"), "keys")
    members = keyed.select("who.row", "who.id", "who.th", "key")
    first = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("who").alias("who"), F.count("*").alias("copies"))
    first = first.select("key", "copies", F.col("who.row").alias("rep"), "who.id", "who.th")
    sigs = keyed.where("key IS NOT NULL").select(F.col("who.row").alias("rep"), "sig")
    return members, kept(first.join(sigs, "rep"), "classes")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) of the documents named by ``wanted`` (rep, id, th)."""
    named = wanted.select("rep", F.col("id").alias("wid"), F.col("th").alias("wth"))
    few = named.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _text(text_col).alias("text"))
    hit = texts.join(F.broadcast(named) if few else named,
                     (F.xxhash64("text") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid")))
    return hit.select("rep", "text").mapInArrow(_sets(n), "rep long, set binary").dropDuplicates(["rep"])


def candidates(classes: DataFrame, threshold: float, recall: float, branch: float, depth: int, limit: int,
               slack: float) -> DataFrame:
    """Pairs (a, b) whose components hold every found pair."""
    sigs = classes.select("rep", "sig")
    runs = runs_for(threshold, recall, branch, depth)
    rows = sigs.mapInArrow(_paths(branch, runs, True), "rep long, node long")
    leaves = None
    for level in range(1, depth + 1):
        rows = kept(rows, "paths")
        count = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"))
        count = kept(count.where("n > 1"), "nodes")
        end = count if level == depth else count.where(F.col("n") <= limit)
        leaf = end.groupBy("n", "mark").agg(F.min("node").alias("node"))  # the same members: once
        members = rows.join(leaf.select("node", "n", "mark"), "node")
        leaves = members if leaves is None else leaves.unionByName(members)
        large = count.where(F.col("n") > limit)
        if level == depth or large.isEmpty():
            break
        rows = rows.join(large.select("node"), "node").join(sigs, "rep").select("rep", "sig", "node").mapInArrow(
            _paths(branch, runs, False), "rep long, node long")
    # leaves of different levels with the same members: once
    leaves = kept(leaves, "leaves")
    once = leaves.groupBy("n", "mark").agg(F.min("node").alias("node"))
    leaves = leaves.join(once, ["n", "mark", "node"]).select("node", "n", "rep")
    tiles = _tiles(leaves.join(sigs, "rep"), "node", limit)
    found = tiles.select("node", "one", "two", "tile", "rep", "sig").groupBy("node", "one", "two").applyInPandas(
        _compare_signatures(threshold - slack), "a long, b long")
    return found


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text",
               recall: float = 0.9999, branch: float = 1.6, depth: int = 3, limit: int = 1024,
               slack: float = 0.2) -> DataFrame:
    """(id, class_id, n_links, component_id, row, group, text_hash) of every document;
    ``group`` numbers the components, ``row`` and ``text_hash`` tell rows apart.

    Words are what white space parts, lower-cased in A-Z; a document's set are its
    runs of ``n`` words, or all its words if it has fewer. Two documents are linked
    if the Jaccard similarity of their sets is >= ``threshold``. ``class_id`` is the
    least id with the same set, ``n_links`` the number of other documents linked
    (copies included), ``component_id`` the least id that links lead to. A null,
    empty or blank text is linked with nothing; its class is its own id. Repeated rows
    are documents of their own; null ids take part and count as larger than any id
    (a class of null ids has a null class_id). An empty table gives no rows.
    """
    members, classes = classes_of(docs, n, id_col, text_col)
    found = kept(candidates(classes, threshold, recall, branch, depth, limit, slack), "candidates")
    groups = components(found)
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("n")), "component").select(
        "component", "n", F.col("node").alias("rep"))
    work = kept(sized.join(classes.select("rep", "id", "th", "copies"), "rep"), "compared")
    work = work.join(sets_of(docs, work, n, id_col, text_col), "rep")
    tiles = _tiles(work, "component", limit)
    checked = kept(tiles.select("component", "one", "two", "tile", "rep", "copies", "set").groupBy(
        "component", "one", "two").applyInPandas(_verify(threshold), "a long, b long, links long"), "links")
    degree = checked.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(checked.where("b <> -1").select("a", "b")).withColumnRenamed("node", "rep")
    of_class = classes.select("rep", "key", "copies").join(degree, "rep", "left").join(linked, "rep", "left").select(
        "key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    placed = members.where("key IS NOT NULL").join(of_class, "key").select("row", "id", "th", "rep", "n_links", "component")
    placed = kept(placed, "placed")
    class_id = placed.groupBy("rep").agg(F.min("id").alias("class_id"))
    component_id = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    out = placed.join(class_id, "rep").join(component_id, "component").select(
        "id", "class_id", "n_links", "component_id", "row", F.col("component").alias("group"), "th")
    alone = members.where("key IS NULL").select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
        "row", F.col("row").alias("group"), "th")
    return out.unionByName(alone).withColumnRenamed("id", id_col).withColumnRenamed("th", "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, with one document of each group of
    linked ones: that with the least id (null ids last). Of rows that agree in id and
    text, one stays. Empty texts are no copies of each other, unless their ids agree."""
    rows = kept(ngram_join(docs, id_col=id_col, text_col=text_col, **options).select(
        F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), "group", "row"), "groups")
    order = F.struct(F.col("_id").isNull(), "_id", "row", "_hash")
    first = rows.groupBy("group").agg(F.min(order).alias("f")).select("f._id", "f._hash").distinct()
    keys = rows.groupBy("_id", "_hash").agg(F.count("*").alias("n"))
    stays = first.select(F.col("_id").alias("i"), F.col("_hash").alias("h"))
    gone = keys.join(stays, keys["_id"].eqNullSafe(stays["i"]) & (keys["_hash"] == stays["h"]), "left_anti")
    out = without(docs, gone, id_col, text_col)
    if not keys.where("n > 1").isEmpty():
        out = out.withColumn("_hash", text_hash(text_col)).dropDuplicates([id_col, "_hash"]).drop("_hash")
    return out
