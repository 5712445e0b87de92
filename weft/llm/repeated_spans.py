"""Removal of long word sequences that occur more than once in a corpus.

Reference shards. Every window of ``length`` words has an anchor: the place, among
its word k-grams, of the one with the least hash (the first of equals). Equal
windows have equal anchors, and consecutive windows mostly share one. Windows are
put together into runs that share an anchor, and a run's text (its *segment*) goes
to the shard of the anchor's k-gram, so all copies of a window meet in one shard,
and each occurrence of a window lies in exactly one segment. Segments are only sent
for anchors that occur more than once; all others hold no repeated window.

Matching. A shard builds a suffix automaton over its distinct segments, counts for
each state how often its strings occur, and streams the segments through it: the
matching statistic at a word is the longest string that ends there and occurs at
least twice. Where it is at least ``length``, the window that ends there occurs
elsewhere too. Maximal spans of such windows go back to their documents.

Hot anchors. A passage that very many documents share, with other words around it,
would put a segment per document into one shard. The windows of an anchor that
occurs more than ``hot`` times are sent on by a 128-bit hash of the whole window
instead, one entry per block and distinct window: equal windows still meet, and the
group is divided among all shards. Their places stay with the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Block, Hashes, blocks, kept, mix, pack, shards_for, starts, unpack

U = np.uint64
GRAM = 8
#: shards for each task that reads input: an automaton takes some hundred bytes a word
SHARDS_PER_TASK = 4
#: an anchor that occurs more often is divided by whole windows
HOT = 1 << 12


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    m = len(words) - k + 1
    if m <= 0:
        return words[:0]
    h = np.zeros(m, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ words[j:j + m]) * U(0x9E3779B97F4A7C15)
            h = h ^ (h >> U(32))
    return mix(h)


def anchors(words: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each run of windows that
    share an anchor place; windows are numbered by their first word."""
    h = gram_hashes(words, k)
    n = len(words) - length + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, h[:0]
    span = length - k + 1  # k-grams in a window
    # place of the first least hash of each window, by doubling the width of the minimum
    best = np.arange(len(h))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        width += step
    best = best[:n]
    first = np.flatnonzero(np.diff(best, prepend=-1))
    return first, np.diff(np.append(first, n)), h[best[first]]


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of every window of ``length`` words."""
    return np.stack([gram_hashes(words, length), gram_hashes(mix(words ^ U(0xD1B54A32D192ED03)), length)], 1)


class Automaton:
    """Suffix automaton over several strings of integers, with occurrence counts."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def add(self, string: list[int], times: int) -> None:
        """Add one string that occurs ``times`` times; strings never run into each other."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None:  # the generalised automaton: the state may be there already
                if length[q] == length[last] + 1:
                    last = q
                else:
                    new = len(length)
                    length.append(length[last] + 1)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    count.append(0)
                    link[q] = new
                    p = last
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
                    last = new
                count[last] += times
                continue
            cur = len(length)
            length.append(length[last] + 1)
            nxt.append({})
            link.append(0)
            count.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    new = len(length)
                    length.append(length[p] + 1)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    count.append(0)
                    link[q] = link[cur] = new
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
            last = cur
            count[last] += times

    def finish(self) -> None:
        """Occurrences of every state: its own and those of the states that link to it."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1].tolist()
        count, link = self.count, self.link
        for s in order:
            if link[s] > 0:
                count[link[s]] += count[s]

    def statistics(self, string: list[int], least: int = 2) -> list[int]:
        """For every place, the length of the longest string that ends there and
        occurs at least ``least`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out, s, n = [], 0, 0
        for c in string:
            while s > 0 and c not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(c, 0)
            n = n + 1 if s else 0
            t, m = s, n
            while t > 0 and count[t] < least:  # shorter strings occur more often
                t = link[t]
                m = length[t]
            # the longest such string is one that a later word can go on from
            s, n = (t, m) if t > 0 else (0, 0)
            out.append(n)
        return out


def repeated(segments: list[list[int]], times: list[int], length: int) -> list[list[int]]:
    """For each distinct segment, the windows (by first word) that occur more than
    once among all occurrences of all segments."""
    a = Automaton()
    for s, n in zip(segments, times, strict=True):
        a.add(s, n)
    a.finish()
    return [[i - length + 1 for i, n in enumerate(a.statistics(s)) if n >= length] for s in segments]


_META = (np.int64, np.uint8, np.int64)
#: numbers, hashes and counts of a block's distinct windows of hot anchors; slots, places and numbers of all of them
_WHOLE = (np.uint32, U, np.uint32, np.uint16, np.uint32, np.uint32)


def _meta(b: Block, shard: int, n_shards: int) -> list[np.ndarray]:
    """Ids, null marks and text hashes of a block's documents; only its home shard gets them."""
    home = shard == (b.number ^ (b.number >> 32)) % n_shards
    ids, hashes = (b.ids, b.flags) if home else ([], [])
    return [np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8),
            np.array(hashes, np.int64)]


def _anchor_rows(length: int, k: int, n_shards: int):
    """Per block and shard: distinct anchors, and the documents that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in blocks(batches):
            keys = [anchors(hashes.array(t.split()), length, k)[2] for t in b.texts]
            slot = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(x) for x in keys])
            key = np.concatenate(keys)
            order = np.lexsort((slot, key, key % U(n_shards)))
            key, slot = key[order], slot[order]
            cut = np.searchsorted(key % U(n_shards), np.arange(n_shards + 1).astype(U))
            shards, out = [], []
            for s in range(n_shards):
                meta, a, z = _meta(b, s, n_shards), int(cut[s]), int(cut[s + 1])
                if a < z or len(meta[0]):
                    value, n = np.unique(key[a:z], return_counts=True)
                    shards.append(s)
                    out.append(pack(np.array([b.number], np.int64), value, n.astype(np.uint32), slot[a:z], *meta))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(out, pa.binary())],
                                             ["shard", "payload"])

    return run


def _shared_anchors(rows: pd.DataFrame, hot: int = HOT) -> pd.DataFrame:
    """(anchor, whether it is hot) of those that occur more than once, for each block."""
    got = [unpack(p, np.int64, U, np.uint32, np.uint16, *_META) for p in rows["payload"]]
    value, inverse = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
    times = np.bincount(inverse, np.concatenate([g[2] for g in got]), len(value))
    shared, divided = value[times > 1], value[times > hot]
    out = []
    for number, key, n, slot, *meta in got:
        hit = np.repeat(np.isin(key, shared), n)
        if hit.any() or len(meta[0]):
            each = np.repeat(key, n)[hit]
            out.append((int(number[0]), pack(slot[hit], np.stack([each, np.isin(each, divided)], 1), *meta)))
    return pd.DataFrame(out, columns=["block", "payload"])


def _gather(kind, more=()):
    """(id, th, what) of the documents of one block that have any: values of ``kind`` put together."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(p, np.uint16, kind, *_META) for p in rows["payload"]] + [*more]
        ids, null, th = next((g[2:] for g in got if len(g[2])), got[0][2:])
        slot = np.concatenate([g[0] for g in got])
        value = np.concatenate([g[1].reshape(len(g[0]), -1) if len(g[0]) else g[1].reshape(0, 1) for g in got
                                if len(g[0])] or [np.zeros((0, 1), kind)])
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], value[order]
        first = np.flatnonzero(np.diff(slot.astype(np.int64), prepend=-1))
        last = np.append(first[1:], len(slot))[:len(first)]
        d = slot[first]
        return pd.DataFrame({
            "id": pd.array([None if x else i for i, x in zip(ids[d].tolist(), null[d], strict=True)], "Int64"),
            "th": th[d], "what": [np.unique(value[a:z], axis=0).tobytes() for a, z in zip(first, last, strict=True)]})

    return run


def _gather_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """As ``_gather`` for spans of windows; windows of hot anchors that some shard found
    to be repeated come from the block's own list of places."""
    got = [unpack(p, np.uint32, np.uint16, np.uint32, np.uint32) for p in rows["hot"]]
    again = np.concatenate([g[0] for g in got])
    slot, start, which = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3))
    hit = np.isin(which, again)
    slot, start = slot[hit], start[hit]
    order = np.lexsort((start, slot))
    slot, start = slot[order], start[order]
    first = np.flatnonzero((np.diff(slot.astype(np.int64), prepend=-1) != 0) | (np.diff(start.astype(np.int64), prepend=-1) != 1))
    last = np.append(first[1:], len(slot))[:len(first)] - 1
    none = [np.zeros(0, k) for k in _META]
    return _gather(np.uint32, [[slot[first], np.stack([start[first], start[last]], 1).ravel(), *none]])(rows)


def _segment_rows(length: int, k: int, n_shards: int):
    """Segments of the runs whose anchor is shared, per block and shard; of hot anchors
    the distinct windows, and for the block's home shard their places. Input: id, text
    and (text hash, shared anchors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in blocks(batches):
            by_shard: dict[int, list] = {}
            places, wholes = [], [np.zeros((0, 2), U)]
            shared_of = [x["anchors"] for x in b.flags]
            b.flags = [x["th"] for x in b.flags]
            for slot, (text, shared) in enumerate(zip(b.texts, shared_of, strict=True)):
                shared, divided = np.unique(np.frombuffer(b"".join(shared), U).reshape(-1, 2), axis=0).T
                words = hashes.array(text.split())
                first, n, key = anchors(words, length, k)
                at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
                match, hot = shared[at] == key, divided[at] > 0
                if (match & hot).any():
                    runs = np.repeat(match & hot, n)
                    begin = np.flatnonzero(runs)  # runs follow each other from window 0
                    wholes.append(window_hashes(words, length)[begin])
                    places.append((slot, begin))
                for j in np.flatnonzero(match & ~hot).tolist():
                    a = int(first[j])
                    by_shard.setdefault(int(key[j] % U(n_shards)), []).append(
                        (slot, a, words[a:a + int(n[j]) + length - 1]))
            whole, at, many = np.unique(np.concatenate(wholes), axis=0, return_inverse=True, return_counts=True)
            owner = whole[:, 0] % U(n_shards)
            spot = np.repeat(np.array([p[0] for p in places], np.uint16), [len(p[1]) for p in places])
            begin = np.concatenate([p[1] for p in places] or [np.zeros(0)]).astype(np.uint32)
            shards, out = [], []
            for s in range(n_shards):
                found, meta = by_shard.get(s, []), _meta(b, s, n_shards)
                mine = np.flatnonzero(owner == U(s))
                if not found and not len(mine) and not len(meta[0]):
                    continue
                own = slice(None) if len(meta[0]) else slice(0)
                distinct: dict[bytes, int] = {}
                which = [distinct.setdefault(f[2].tobytes(), len(distinct)) for f in found]
                # words as places in the list of those this row needs
                near, place = np.unique(np.frombuffer(b"".join(distinct), U), return_inverse=True)
                small = np.uint16 if len(near) < 1 << 16 else np.uint32
                shards.append(s)
                out.append(pack(
                    np.array([b.number], np.int64), near, np.array([len(x) // 8 for x in distinct], np.uint32),
                    place.astype(small).view(np.uint8), np.array(which, np.uint32),
                    np.array([f[0] for f in found], np.uint16), np.array([f[1] for f in found], np.uint32), *meta,
                    mine.astype(np.uint32), whole[mine], many[mine].astype(np.uint32),
                    spot[own], begin[own], at.ravel()[own].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(out, pa.binary())],
                                             ["shard", "payload"])

    return run


def _match(length: int):
    """Spans of repeated windows (first and last window), for each block."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(p, np.int64, U, np.uint32, np.uint8, np.uint32, np.uint16, np.uint32, *_META, *_WHOLE)
               for p in rows["payload"]]
        hot = [(g[10], g[11].reshape(-1, 2), *g[12:]) for g in got]
        got = [g[:10] for g in got]
        _, of = np.unique(np.concatenate([h[1] for h in hot]), axis=0, return_inverse=True)
        of = of.ravel()
        again = np.bincount(of, np.concatenate([h[2] for h in hot]))[of] > 1 if len(of) else np.zeros(0, bool)
        at = starts([len(h[0]) for h in hot]).tolist()
        hot = [(h[0][again[a:z]], *h[3:]) for h, a, z in zip(hot, at[:-1], at[1:], strict=True)]
        words = np.unique(np.concatenate([g[1] for g in got]))
        number: dict[bytes, int] = {}
        times: list[int] = []
        maps = []
        for _b, near, sizes, place, which, *_ in got:
            place = place.view(np.uint16 if len(near) < 1 << 16 else np.uint32)
            data = np.searchsorted(words, near).astype(np.uint32)[place].tobytes()
            cut, own = (4 * starts(sizes)).tolist(), []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                b = data[a:z]
                j = number.setdefault(b, len(number))
                if j == len(times):
                    times.append(0)
                own.append(j)
            for j, n in zip(own, np.bincount(which, minlength=len(own)).tolist(), strict=True):
                times[j] += n
            maps.append(own)
        spans = []
        for w in repeated([np.frombuffer(b, np.uint32).tolist() for b in number], times, length):
            w = np.array(w, np.int64)
            edge = np.flatnonzero(np.diff(w) != 1)
            spans.append(np.stack([w[np.concatenate([[0], edge + 1])], w[np.concatenate([edge, [len(w) - 1]])]], 1)
                         if len(w) else np.zeros((0, 2), np.int64))
        out = []
        for (block, _n, _s, _p, which, slot, start, *meta), own, whole in zip(got, maps, hot, strict=True):
            which = [own[j] for j in which.tolist()]
            n = np.array([len(spans[j]) for j in which], np.int64)
            if n.sum() or len(whole[0]) or len(meta[0]):
                at = (np.concatenate([spans[j] for j in which]) + np.repeat(start.astype(np.int64), n)[:, None]
                      if len(which) else np.zeros((0, 2)))
                out.append((int(block[0]), pack(np.repeat(slot, n), at.astype(np.uint32).ravel(), *meta), pack(*whole)))
        return pd.DataFrame(out, columns=["block", "payload", "hot"])

    return run


def _remove(length: int):
    """(id, n_words, n_removed, kept words joined by a space) of (id, windows, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, texts = [], [], []
            for windows, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if windows:
                    mark = np.zeros(len(words) + 1, np.int64)
                    spans = np.frombuffer(b"".join(windows), np.uint32).reshape(-1, 2).astype(np.int64)
                    np.add.at(mark, spans[:, 0], 1)
                    np.add.at(mark, spans[:, 1] + length, -1)
                    out = np.cumsum(mark[:-1]) > 0
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary())],
                ["id", "n_words", "n_removed", "kept"])

    return run


def _by_document(found: DataFrame, what: str) -> DataFrame:
    return found.groupBy("id", "th").agg(F.collect_list("what").alias(what))


def _with_texts(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join rows per (id, th) to the documents, the same way at every size."""
    side = found.withColumnRenamed("id", "fid").withColumnRenamed("th", "fth")
    return docs.join(side, (F.col("th") == F.col("fth")) & F.col("id").eqNullSafe(F.col("fid")), how)


def remove_repeated(docs: DataFrame, length: int = 35, k: int = GRAM, id_col: str = "doc_id",
                    text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept) for every document: ``kept`` (binary) are the
    words that stay, joined by one space.

    Words are what the six ASCII white-space characters part, unchanged. A word goes
    if a window of ``length`` words that covers it starts anywhere else in the table
    too, in the same document or another; windows are judged on the input. A null
    text is empty; a text of fewer than ``length`` words stays whole. A repeated
    row repeats all its windows, so both go. A null id stays null. Other columns are
    ignored; an empty table gives no rows. Words are compared by 64-bit hashes,
    and windows of anchors that occur more than ``hot`` times by 128-bit hashes; the
    result does not depend on ``hot``.
    """
    if not 1 <= k <= length:
        raise ValueError("1 <= k <= length")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    view = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    n = SHARDS_PER_TASK * shards_for(view)
    routed, block, document = "shard int, payload binary", "block long, payload binary", "id long, th long, what binary"
    anchored = view.select("id", "text", "th").mapInArrow(_anchor_rows(length, k, n), routed)
    shared = anchored.groupBy("shard").applyInPandas(lambda r: _shared_anchors(r, hot), block).groupBy("block").applyInPandas(
        _gather(U), document)
    shared = kept(_by_document(shared, "anchors"), "anchors")
    some = _with_texts(view, shared, "inner").select(
        "id", "text", F.struct("th", "anchors").alias("found"))
    segments = some.mapInArrow(_segment_rows(length, k, n), routed)
    found = segments.groupBy("shard").applyInPandas(_match(length), f"{block}, hot binary").groupBy("block").applyInPandas(
        _gather_windows, document)
    found = kept(_by_document(found, "windows"), "windows")
    rows = _with_texts(view, found, "left").select("id", "windows", "text")
    out = rows.mapInArrow(_remove(length), "id long, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", id_col)


def digest(removed: DataFrame) -> DataFrame:
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


