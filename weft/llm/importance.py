"""Quality selection by importance resampling over hashed n-grams.

Two generative models are fitted: one to target text (labelled rows worth
keeping), one to raw text (all documents). Text is modelled by its hashed n-grams:
byte n-grams (digits made one digit) and n-grams over the marks "same word as before /
another word", which show repetition. The evidence of a window of text is the mean, over
its n-grams, of

    log p_target(n-gram) - log p_raw(n-gram)

for and against alike. A document is as good as its worst window. The worst of m clean
windows lies lower than that of one: a share f of them has an exponential tail of some
scale, so about scale * log(1 + f * m) is given back, with both fitted to the windows of
held-out target rows. So neither length nor the number of windows counts. The importance
weight takes every document for as many n-grams (``GRAMS``):

    log-weight = GRAMS * (worst window + scale * log(1 + f * windows))

Documents are drawn without replacement in proportion to exp(log-weight): the top k of
log-weight plus Gumbel noise keyed by the id.

Models are fixed-size count vectors, added up in a tree of tasks; the only rows
the driver sees are those vectors and histograms of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept, pack, trim, unpack, without

BUCKETS = 1 << 18
N = 4
CHUNK = 1 << 13     # buckets per row of a count vector
FAN_IN = 32         # vectors added up by one task
BINS = 1024
#: target labels (an id and a flag, some 24 bytes) sent to every executor at most
BROADCAST_ROWS = 1 << 20
_ONE_DIGIT = bytes.maketrans(b"0123456789\r\n\t", b"0000000000   ")
#: texts hashed together; a longer text is hashed alone
_GROUP_BYTES = 1 << 19
#: bytes of a window, those it shares with the next, and how far an edge moves to white space
WINDOW, SHARED, EDGE = 512, 16, 32
#: window means below -TAIL are the tail that the scale is fitted to, with one excess seen before
TAIL, EXCESS = 0.01, 0.01
#: n-grams that every document is taken for
GRAMS = 100


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct hashed n-grams of each text."""
    parts, owner = [], []
    for t in texts:
        words = t.split()
        same = bytes(map(eq, words, words[1:]))
        p = b" " + t.translate(_ONE_DIGIT) + b" \x02" + same.replace(b"\x00", b"\x03") + b"\x02"
        parts.append(p)
        owner.append(len(p))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    doc = np.repeat(np.arange(len(parts), dtype=np.int64), owner)
    n = len(raw) - N + 1
    code = np.zeros(n, np.uint64)
    for k in range(N):
        code |= raw[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code >>= np.uint64(64 - (buckets - 1).bit_length())
    inside = doc[:n] == doc[N - 1:]  # not across two texts
    # distinct (document, bucket) by sorting, in 32 bits where they fit: that is much faster than hashing
    kind = np.uint32 if len(parts) * buckets < 1 << 32 else np.uint64
    both = doc[:n][inside].astype(kind) * kind(buckets) + code[inside].astype(kind)
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both // kind(buckets)).astype(np.int64), (both % kind(buckets)).astype(np.int64)


def windows(text: bytes) -> list[bytes]:
    """A text in windows of about equal length that overlap; edges lie at white space if any is near."""
    if len(text) <= WINDOW:
        return [text]
    n = -(-(len(text) - SHARED) // (WINDOW - SHARED))
    step, out = (len(text) - SHARED) / n, []
    for j in range(n):
        a, z = int(j * step), len(text) if j == n - 1 else int((j + 1) * step) + SHARED
        space = text.rfind(b" ", max(0, a - EDGE), a) if j else -1
        a = space + 1 if space >= 0 else a
        space = text.find(b" ", z, z + EDGE)
        out.append(text[a:space if space >= 0 else z])
    return out


def _groups(batches: Iterator[pa.RecordBatch]):
    """Rows of the task in groups of bounded size: lists of columns."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            size += len(row[0])
            if size >= _GROUP_BYTES:
                yield [list(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]
    held = None
    trim()


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of each bucket in raw and target rows of this task, in chunks."""
    from pyspark import TaskContext
    counts = np.zeros((2, BUCKETS), np.int64)
    docs = np.zeros(2, np.int64)
    for texts, target in _groups(batches):
        doc, bucket = features(texts)
        target = np.array(target, bool)
        docs += len(texts), target.sum()
        counts[0] += np.bincount(bucket, minlength=BUCKETS)
        counts[1] += np.bincount(bucket[target[doc]], minlength=BUCKETS)
    task = TaskContext.get().partitionId()
    for c in range(BUCKETS // CHUNK):
        part = counts[:, c * CHUNK:(c + 1) * CHUNK]
        if part.any() or (c == 0 and docs[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([task], pa.int32()),
                 pa.array([pack(docs * (c == 0), np.ascontiguousarray(part).ravel())], pa.binary())],
                ["chunk", "task", "counts"])


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    docs, counts = np.zeros(2, np.int64), np.zeros(2 * CHUNK, np.int64)
    for p in rows["counts"]:
        d, c = unpack(p, np.int64, np.int64)
        docs, counts = docs + d, counts + c
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "task": [rows["task"].iloc[0] // FAN_IN],
                         "counts": [pack(docs, counts)]})


def fit(rows: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw and target document counts per bucket, raw and target documents).

    ``rows``: text (binary), target (boolean). Vectors are added in a tree."""
    shape = "chunk int, task int, counts binary"
    vectors = rows.mapInArrow(_fit, shape)
    while True:
        step = vectors.withColumn("node", F.floor(F.col("task") / FAN_IN))
        vectors = step.groupBy("chunk", "node").applyInPandas(lambda r: _add(r), shape)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    counts, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in vectors.collect():  # BUCKETS / CHUNK rows
        d, c = unpack(r["counts"], np.int64, np.int64)
        docs += d
        counts[:, r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = c.reshape(2, CHUNK)
    return counts, docs


def log_ratio(counts: np.ndarray, prior: float = 0.1) -> np.ndarray:
    """log p_target - log p_raw of every bucket, the target model smoothed by ``prior``
    occurrences. Zero without target text."""
    raw, target = counts.astype(np.float64)
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))


_WEIGHED = ["id", "text_hash", "worst", "windows", "tail", "excess"]


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, hashes in _groups(batches):
            parts = [windows(t) for t in texts]
            n = np.array([len(x) for x in parts], np.int64)
            doc, bucket = features([w for x in parts for w in x])
            m = int(n.sum())
            w = np.bincount(doc, ratio[bucket], m) / np.maximum(1, np.bincount(doc, minlength=m))
            first, beyond = np.cumsum(n) - n, np.maximum(0.0, -TAIL - w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(np.minimum.reduceat(w, first)),
                 pa.array(n), pa.array(np.add.reduceat((beyond > 0).astype(np.int64), first)),
                 pa.array(np.add.reduceat(beyond, first))], _WEIGHED)

    return run


def tail_scale(rows: DataFrame) -> tuple[float, float]:
    """(scale, share): mean excess beyond ``TAIL`` of the windows of held-out target rows,
    the scale of an exponential tail, and the share of windows in it. One window with an
    excess of ``EXCESS`` is taken as seen before."""
    n, excess, m = rows.where("holdout AND good").agg(F.sum("tail"), F.sum("excess"), F.sum("windows")).first()
    return ((excess or 0.0) + EXCESS) / ((n or 0) + 1), ((n or 0) + 1) / ((m or 0) + 2)


def _noise(seed: int):
    """Standard Gumbel noise from the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def best_cut(rows: DataFrame) -> float:
    """The log-weight at or above which held-out labelled rows are best told apart (mean
    of both classes' shares that are right), from a histogram: a quarter of
    the way from the labelled rows that stay to those that go, as unlabelled clean rows
    lie a little lower than the lowest labelled one."""
    binned = rows.where("holdout AND good IS NOT NULL").groupBy(
        F.greatest(F.floor(F.col("log_weight") * 8), F.lit(-8 * BINS)).cast("long").alias("bin")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n"))
    bins = sorted((r["bin"], r["good"], r["n"] - r["good"]) for r in binned.collect())  # at most 8 * BINS + 1 rows
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return -math.inf
    best, cut, below_good, below_bad, last = -1.0, -math.inf, 0, 0, -math.inf
    for b, g, x in bins:
        score = below_bad / bad + (good - below_good) / good
        if score > best:
            best, cut = score, (3 * b + last) / 32
        below_good, below_bad, last = below_good + g, below_bad + x, b + 1
    return cut


def cut_of_top(rows: DataFrame, key: str, k: int) -> tuple[float, int]:
    """(value, r): the k rows with the largest keys are those above ``value`` and r
    of those that equal it; exact, by histograms that close in on the k-th key."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    need = k
    while lo < hi:
        width = (hi - lo) / BINS
        at = F.least(F.floor((F.col(key) - lo) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        inside = rows.where(F.col(key).between(lo, hi)).groupBy(at.alias("bin")).agg(
            F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if need <= r["n"]:
                break
            need -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            return hi, need  # neighbouring doubles
        lo, hi = r["lo"], r["hi"]
    return lo, need


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id",
                      text_col: str = "text", grams: float = GRAMS, holdout: int = 5,
                      seed: int = 11) -> DataFrame:
    """(id, text_hash, log_weight, key, selected) for every row of ``docs``.

    ``labels`` (``id_col``, quality, toxic): rows with quality 1 and toxic not 1
    are target text. Every ``holdout``-th target row (by hash) stays out of the
    target model, and with the rejected rows gives the cut: without ``k``, as many
    rows are drawn as have a log-weight at or above it. An id with several labels
    counts as target only if all of them do. Without target rows, or without
    rejected ones, all rows are drawn. A null text is empty; a null id has no
    label. Repeated rows are weighed each. Ties in the key are drawn by id. An
    empty table gives no rows. Other columns of both tables are ignored.
    """
    ok = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), F.lit(False))
    label = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.min(ok).alias("good"))
    label = label.withColumn("holdout", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(holdout)) == 0)
    view = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
                       F.col(id_col).cast("long").alias("id"))
    tasks = view.rdd.getNumPartitions()
    label = kept(label, "labels")
    target = label.where("good AND NOT holdout").select("id", F.lit(True).alias("target"))
    if target.count() <= BROADCAST_ROWS:
        target = F.broadcast(target)
    rows = view.join(target, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts, _ = fit(rows, max(tasks, 1))
    weighed = view.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _weigh(log_ratio(counts)),
        "id long, text_hash long, worst double, windows long, tail long, excess double")
    checked = label.select("id", "good", (F.col("holdout") | ~F.col("good")).alias("holdout"))
    weighed = weighed.join(checked, "id", "left").select(
        "id", "text_hash", "good", F.coalesce("holdout", F.lit(False)).alias("holdout"), *_WEIGHED[2:])
    weighed = kept(weighed, "weights")
    scale, share = tail_scale(weighed)
    weight = F.lit(float(grams)) * (F.col("worst") + scale * F.log1p(F.col("windows") * share))
    weighed = weighed.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + _noise(seed))
    if k is None:
        k = weighed.where(F.col("log_weight") >= best_cut(weighed)).count()
    total = weighed.count()
    if k >= total:
        chosen = weighed.withColumn("selected", F.lit(True))
    elif k <= 0:
        chosen = weighed.withColumn("selected", F.lit(False))
    else:
        at, ties = cut_of_top(weighed, "key", k)
        equal = weighed.where(F.col("key") == at)
        if equal.count() > ties:  # equal keys: equal ids, or a very rare chance
            last = equal.orderBy(F.col("id").asc_nulls_last()).limit(ties)
            rest = equal.exceptAll(last)
            chosen = weighed.where(F.col("key") != at).withColumn("selected", F.col("key") > at).unionByName(
                last.withColumn("selected", F.lit(True))).unionByName(rest.withColumn("selected", F.lit(False)))
        else:
            chosen = weighed.withColumn("selected", F.col("key") >= at)
    return chosen.select(F.col("id").alias(id_col), "text_hash", "log_weight", "key", "selected")


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns kept. Copies of a row (same id and
    text) stay if one of them is drawn."""
    drawn = importance_sample(docs, labels, id_col=id_col, text_col=text_col, **options)
    keys = drawn.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), "selected")
    gone = keys.groupBy("_id", "_hash").agg(F.max("selected").alias("stays")).where("NOT stays")
    return without(docs, gone, id_col, text_col)
