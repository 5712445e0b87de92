"""Language-model scores from an n-gram trie in Elias-Fano levels.

Model. Words are what white space parts, lower-cased in A-Z, and one end per
text. With N training tokens, V distinct ones and context h of order - 1
tokens (the text's start padded):

    p(w)     = (c(w) - discount) / N,     for an unseen word discount * V / N
    p(w | h) = (c(h w) + strength * p(w)) / (c(h) + strength)

which sums to one over the V words and one unseen word. The logarithm splits
into a part that only n-grams ending in w decide (the numerator) and a part
that only n-grams ending in the context's last word decide (the denominator).
So n-grams are sharded by their *last* word: a shard owns a trie read from the
last word backwards, and adds up both parts for each document without asking
any other shard.

Trie. Level 1 holds the hashes of the shard's words, level k the words before,
as context-relative ids: a node's id is its parent's position times the number
of context words plus the context word's number, which makes each level one
ascending sequence; it is stored in Elias-Fano code and searched by successor.
Smoothed log-probabilities are quantised to one byte with a code book per level.
The levels are written to a file, mapped into memory, and the file's name is
removed at once, so nothing stays on an executor's disk.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import elias_fano as EF
from weft.llm.common import Hashes, Ids, blocks, distinct, kept, pack, shards_for, starts, trim, unpack

#: words are known by 48 bits of their hash; two words are only ever compared within a shard
HASH_BITS = 48
END = np.uint64(0x9E3779B97F4A)    # the end of a text, as a word
START = np.uint64(0xD1B54A32D192)  # the padding before a text
#: shards for each task that reads input: a shard's arrays must fit beside another's in an executor
SHARDS_PER_TASK = 4
_ROUTED = "shard int, payload binary"
_PARTIAL = "block long, sums binary"
_SUMS = (np.uint8, np.uint16, np.float64, np.float64, np.uint32, np.uint32, np.int64, np.uint8, np.uint8, np.uint32)
_MANY = 0xFFFF  # numbers from this on are kept apart from the 16-bit ones
_SCORED = "id long, train boolean, n_tokens long, n_known long, base double, score double, vocabulary long"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text: bytes.split() parts at the six ASCII white-space bytes."""
    return text.lower().split()


def narrow(hashes: np.ndarray) -> np.ndarray:
    """48-bit hashes as bytes, their low 32 bits first."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)
    return np.concatenate([low.view(np.uint8), high.view(np.uint8)])


def widen(data: np.ndarray) -> np.ndarray:
    n = len(data) // 6
    return data[:4 * n].view(np.uint32).astype(np.uint64) | (
        data[4 * n:].view(np.uint16).astype(np.uint64) << np.uint64(32))


# ---- quantised levels ------------------------------------------------------

def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one byte per value, code book of at most 256 means)."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    kinds = distinct(values)
    if len(kinds) <= 256:
        return np.searchsorted(kinds, values).astype(np.uint8), kinds
    # half the edges by rank, half by value: rare extremes get fine bins too
    edges = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, 129)[1:-1]),
                                      np.linspace(kinds[0], kinds[-1], 130)[1:-1]]))
    code = np.searchsorted(edges, values, side="right")
    total = np.bincount(code, values, minlength=len(edges) + 1)
    n = np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), total / np.maximum(n, 1)


class Trie:
    """Levels of a shard: ``contexts`` and ``words`` are sorted word hashes,
    ``levels[k]`` the ascending node ids of level k + 2; ``prob`` are the last
    level's and level 1's log10 values, ``total`` those of level order - 1."""

    def __init__(self, contexts, words, levels, prob_words, prob_top, total):
        def book(values):
            code, means = quantise(values)
            return pack(code, means)
        n_ctx = max(1, len(contexts))
        sizes = [len(words), *map(len, levels)]
        parts = [EF.encode(contexts, 1 << HASH_BITS), EF.encode(words, 1 << HASH_BITS)]
        parts += [EF.encode(x, max(1, sizes[k]) * n_ctx) for k, x in enumerate(levels)]
        parts += [book(prob_words), book(prob_top), book(total)]
        parts = [p + bytes(-len(p) % 8) for p in parts]
        fd, path = tempfile.mkstemp(prefix="weft-trie-")
        with os.fdopen(fd, "wb") as f:
            f.write(b"".join(parts))
        data = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        cut = starts([len(p) for p in parts])
        at = [data[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        self.contexts, self.words = EF.Sequence(at[0]), EF.Sequence(at[1])
        self.levels = [EF.Sequence(x) for x in at[2:2 + len(levels)]]
        self.prob_words, self.prob_top, self.total = ([*unpack(x, np.uint8, np.float64)] for x in at[-3:])
        self.n_ctx, self.bytes = n_ctx, int(cut[-1])

    @staticmethod
    def value(book, node: np.ndarray) -> np.ndarray:
        """Dequantised values of nodes (any node below 0 gives the first value)."""
        code, means = book
        return means[code[np.maximum(node, 0)]] if len(code) else np.zeros(len(node))


# ---- tasks ------------------------------------------------------------------

def _route(n_shards: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in blocks(batches):
            ids, words = Ids(), []
            start, end = ids[0], ids[1]  # ints, so no word has them
            for t in b.texts:
                words.append(list(map(ids.__getitem__, tokens(t))))
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            uid = np.full(int(sizes.sum()), end, np.int32)
            cut = starts(sizes)
            for w, a in zip(words, cut.tolist(), strict=False):
                uid[a:a + len(w)] = w
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            pos = (np.arange(len(uid)) - cut[doc]).astype(np.int32)
            key = np.empty(len(ids), np.uint64)
            key[0], key[1] = START, END
            key[2:] = hashes.array(list(ids)[2:]) >> np.uint64(64 - HASH_BITS)
            del words
            rank = np.empty(len(ids), np.int32)  # words in order of shard
            by_shard = np.argsort(key % np.uint64(n_shards), kind="stable")
            rank[by_shard] = np.arange(len(ids))
            key = key[by_shard]
            cols = [rank[uid]]
            for k in range(1, order):
                before = np.full(len(uid), rank[start], np.int32)
                before[k:] = cols[0][:-k]
                before[pos < k] = rank[start]
                cols.append(before)
            del pos, uid
            node = cols[0].astype(np.int64)
            for c in cols[1:]:  # a number for each distinct n-gram, in order of its words
                _, node = np.unique(node * len(ids) + c, return_inverse=True)
            by_node = np.argsort(node, kind="stable")
            first = np.flatnonzero(np.diff(node[by_node], prepend=-1))
            cols = [c[by_node][first] for c in cols]
            holders = np.diff(np.append(first, len(node)))
            doc = doc[by_node]
            bounds = np.searchsorted(key[cols[0]] % np.uint64(n_shards), np.arange(n_shards + 1).astype(np.uint64))
            at = starts(holders)
            train = np.packbits(np.array([bool(f) for f in b.flags], np.uint8))
            home = (b.number ^ (b.number >> 32)) % n_shards
            shards, payloads = [], []
            for s in range(n_shards):
                lo, hi = int(bounds[s]), int(bounds[s + 1])
                if lo == hi and s != home:
                    continue
                w, per = np.unique(cols[0][lo:hi], return_counts=True)
                meta = b.ids if s == home else []
                # the words before stand as places in the list of those this row needs
                near, place = np.unique(np.concatenate([c[lo:hi] for c in cols[1:]] or [w[:0]]), return_inverse=True)
                small = np.uint16 if len(near) < 1 << 16 else np.uint32
                payloads.append(pack(
                    np.array([b.number, len(sizes)], np.int64), train, narrow(key[w]), per.astype(np.uint32),
                    holders[lo:hi].astype(np.uint32), doc[at[lo]:at[hi]],
                    np.array([x or 0 for x in meta], np.int64), np.array([x is None for x in meta], np.uint8),
                    sizes.astype(np.uint32) if s == home else np.zeros(0, np.uint32), narrow(key[near]), place.astype(small).view(np.uint8)))
                shards.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())],
                                             ["shard", "payload"])

    return run


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them, in 32 bits."""
    order = np.argsort(x)
    x = x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    kinds, number = x[new], np.cumsum(new, dtype=np.int32)
    del x, new
    number -= 1
    place = np.empty(len(order), np.int32)
    place[order] = number
    return kinds, place


def _score(order: int, n_train: int, strength: float, discount: float):
    def run(rows: pa.Table) -> pa.Table:
        trim()  # what the group before left
        kinds = (np.int64, np.uint8, np.uint8, np.uint32, np.uint32, np.uint16, np.int64, np.uint8, np.uint32,
                 np.uint8, np.uint8)
        # views of the payloads; what grows with the shard is held in few bytes an entry, and steps that
        # need more go block by block
        got = [unpack(x.as_buffer(), *kinds) for part in rows.column("payload").chunks for x in part]
        for g in got:
            g[2], g[9] = widen(g[2]), widen(g[9])
        flags = [np.unpackbits(g[1], count=int(g[0][1])).astype(bool) for g in got]
        seen, leaf_word = _numbered(np.concatenate([g[2] for g in got]))
        leaf_word = np.repeat(leaf_word, np.concatenate([g[3] for g in got]))
        # training occurrences of each entry; an entry has a holder at least
        n_leaf = np.concatenate([np.add.reduceat(f[g[5]], starts(g[4])[:-1], dtype=np.int32) if len(g[4]) else
                                 np.zeros(0, np.int32) for g, f in zip(got, flags, strict=True)])

        contexts = distinct(np.concatenate([g[9] for g in got]))
        n_ctx = max(1, len(contexts))
        before = [np.empty(len(leaf_word), np.int32) for _ in range(order - 1)]
        lo = 0
        for g in got:
            n = len(g[4])
            place = g[10].view(np.uint16 if len(g[9]) < 1 << 16 else np.uint32)
            number = np.searchsorted(contexts, g[9]).astype(np.int32)
            for k in range(order - 1):
                before[k][lo:lo + n] = number[place[k * n:(k + 1) * n]]
            lo += n
            g[9] = g[10] = place = None
        # nodes seen here, trained or not: their ids are the queries, those trained make the trie
        queries, counts, of_leaf, parent = [seen], [np.bincount(leaf_word, n_leaf, len(seen))], [leaf_word], leaf_word
        while before:
            node = parent.astype(np.int64)
            node *= n_ctx
            node += before.pop(0)
            q, parent = _numbered(node)
            del node
            queries.append(q)
            counts.append(np.bincount(parent, n_leaf, len(q)))
            of_leaf.append(parent)
        del n_leaf, parent

        # trie of the trained nodes: a node's id is made of its parent's place in the trie
        has = [c > 0 for c in counts]
        levels = []
        for k in range(1, order):
            q = queries[k][has[k]]
            place = np.cumsum(has[k - 1], dtype=np.int32) - 1
            levels.append((place[q // n_ctx] * np.int64(n_ctx) + q % n_ctx).astype(np.uint64))
            del q, place
        known = counts[0][has[0]]
        p_word = (known - discount) / max(1, n_train)
        if order > 1:  # word of each node of the last level
            word = np.zeros(len(queries[-1]), np.int32)
            word[of_leaf[-1]] = leaf_word
            place = np.cumsum(has[0], dtype=np.int32) - 1
            top = np.log10(counts[-1][has[-1]] + strength * p_word[place[word[has[-1]]]])
            total = np.log10(counts[order - 2][has[order - 2]] + strength)
            del word, place
        else:
            top, total = np.log10(p_word), np.zeros(0)
        base = np.log10(counts[0] + 0.1)
        del counts
        trie = Trie(contexts, seen[has[0]], levels, np.log10(p_word), top, total)
        is_known = has[0]
        del levels, top, total, has
        trim()

        # queries: every n-gram seen here, known or not
        node = trie.words.find(seen)
        word_node = node
        chain = [node.astype(np.int32)]
        context = trie.contexts.find(contexts)
        for k in range(1, order):
            q = queries[k]
            queries[k] = None
            up = np.full(len(q), -1, np.int32)
            for at in range(0, len(q), EF.AT_ONCE):
                x = q[at:at + EF.AT_ONCE]
                parent, c = chain[-1][x // n_ctx], context[x % n_ctx]
                ok = np.flatnonzero((parent >= 0) & (c >= 0))
                up[at + ok] = trie.levels[k - 1].find((parent[ok] * np.int64(trie.n_ctx) + c[ok]).astype(np.uint64))
            chain.append(up)
            del q
        unseen_word = np.log10(discount / max(1, n_train))  # log10(V) is added where V is known
        lower = np.where(word_node >= 0, Trie.value(trie.prob_words, word_node), unseen_word)

        out, lo = [], 0
        for g, f in zip(got, flags, strict=True):
            hi = lo + len(g[4])
            doc, per, leaf = g[5], g[4], leaf_word[lo:hi]
            part = lower[leaf] + (np.log10(strength) if order > 1 else 0.0)
            if order > 1:
                last = chain[-1][of_leaf[-1][lo:hi]]
                part = np.where(last >= 0, Trie.value(trie.prob_top, last), part)
                mid = chain[order - 2][of_leaf[order - 2][lo:hi]]
                owed = np.where(mid >= 0, Trie.value(trie.total, mid), np.log10(strength))
                part = part - np.where(seen[leaf] == END, 0.0, owed)  # as the next token's context
            n = np.bincount(doc)
            slot = np.flatnonzero(n)
            unknown, bases, parts = (np.bincount(doc, np.repeat(x, per)) for x in (~is_known[leaf], base[leaf], part))
            home = f.astype(np.uint8) if len(g[6]) else np.zeros(0, np.uint8)
            # most documents of a block have tokens in most shards: which ones is a bit each
            few = unknown[slot].astype(np.uint32)
            many = np.flatnonzero(few >= _MANY)
            out.append((int(g[0][0]), pack(np.packbits(n > 0), np.minimum(few, _MANY).astype(np.uint16), bases[slot],
                                           parts[slot], many.astype(np.uint32), few[many], g[6], g[7], home, g[8])))
            lo = hi
        # one more row: the shard's distinct training words
        out.append((-1, np.array([is_known.sum()], np.int64).tobytes()))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                         "sums": pa.array([x for _, x in out], pa.binary())})

    return run


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block, from what each shard found in them; block -1 adds up the vocabulary."""
    if rows["block"].iloc[0] < 0:
        v = sum(int(np.frombuffer(p, np.int64)[0]) for p in rows["sums"])
        return pd.DataFrame({"id": pd.array([None], "Int64"), "train": [False], "n_tokens": [0], "n_known": [0],
                             "base": [0.0], "score": [0.0], "vocabulary": pd.array([v], "Int64")})
    got = [unpack(p, *_SUMS) for p in rows["sums"]]
    ids, null, train, size = next((g[6:] for g in got if len(g[6])), got[0][6:])
    sums = [np.zeros(len(ids), k) for k in (np.int64, np.float64, np.float64)]
    for some, few, base, score, many, true, *_meta in got:
        slot = np.flatnonzero(np.unpackbits(some)[:len(ids)])
        few = few.astype(np.int64)
        few[many] = true
        for total, v in zip(sums, (few, base, score), strict=True):
            total[slot] += v
    return pd.DataFrame({"id": pd.array([None if x else i for i, x in zip(ids.tolist(), null, strict=True)], "Int64"),
                         "train": train > 0, "n_tokens": size.astype(np.int64), "n_known": size - sums[0],
                         "base": sums[1], "score": sums[2], "vocabulary": pd.array([None] * len(ids), "Int64")})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = docs = 0
    for b in batches:
        for t in b.column(0).to_pylist():
            n += len(t.split()) + 1
            docs += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([docs])], ["n", "docs"])


def ngram_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
                 strength: float = 8.0, discount: float = 0.75, n_shards: int | None = None) -> DataFrame:
    """Score every row of ``docs`` with the model learnt from the rows where the
    boolean column ``train`` holds (null: not).

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (words
    alone, add-0.1) and score, the log10 probability of the text with its end.
    A null text is empty: its end is its one token. A null id stays null.
    Repeated rows are scored each. Without training rows every token is unseen
    (one training token and one word are assumed). Other columns are ignored;
    an empty table gives no rows. All counts are over all training rows.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    view = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("flag"))
    size = view.where("flag").select("text").mapInArrow(_count, "n long, docs long").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")).first()
    n_train, n_docs = size["n"] or 0, size["docs"] or 0
    shards = n_shards or SHARDS_PER_TASK * shards_for(view)
    partial = view.mapInArrow(_route(shards, order), _ROUTED).groupBy("shard").applyInArrow(
        _score(order, n_train, strength, discount), _PARTIAL)
    sums = kept(partial.groupBy("block").applyInPandas(_gather, _SCORED), "ngram")
    vocabulary = sums.agg(F.sum("vocabulary")).first()[0] or 0
    base = float(np.log10(n_train + 0.1 * (vocabulary + 1)))
    opening = float(np.log10(n_docs + strength)) if order > 1 else 0.0
    unseen = float(np.log10(max(1, vocabulary)))
    n_unknown = F.col("n_tokens") - F.col("n_known")
    return sums.where("vocabulary IS NULL").select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens",
        "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score") + n_unknown * unseen - opening).alias("score"))
