"""Byte-pair vocabulary and encoder (K2, K3).

Learning is exact: the merges are those of the plain loop that merges the most
frequent pair (ties by the two symbols) and counts anew, but a Spark round finds
many of them at once. With a cut c, call a pair of neighbours strong if its count is
at least c. A merge only makes pairs with its new symbol, and such a pair is no more
frequent than the pair it replaces: (x, ab) is counted at most as often as (x, a) was.
(A string that is a token already is never merged a second way, so no symbol comes
back.) So a pair that is weak now, and whatever grows across it, stays below c until
nothing with c or more is left; all merges down to c happen inside runs of symbols
that strong pairs join. Equal runs are added up over all pieces, and when few enough
distinct runs are left (``max_runs``), one loop over them with an index from pairs to
runs gives every merge down to c. The merges are then applied to all pieces, in
parallel, and the next round takes a lower cut. Pieces are kept as packed blocks of
numbered symbols, so a pass over them is array arithmetic and one lookup per run, and
a round writes them once; those that have become one symbol are left out. The first cut that leaves few runs is
found by the counts of the pairs; the most frequent pair alone always does.

Encoding takes the distinct pieces of some texts together, in array arithmetic: a step merges
in each piece all places of its pair of the least rank. Long pieces go one by one, with a
heap and a linked list, so a piece of any length takes n log n steps; characters that
are no tokens become the tokens of their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.tokens import BOS, BYTE_BASE, FIRST_PIECE_ID, METASPACE, PY_PIECE_RE, SPECIALS, _utf8, encode_texts
from weft.session import cut_lineage, spread

#: distinct runs (some symbols and a count each) that one loop goes over at most
MAX_RUNS = 200_000
#: vocabulary rows sent to every executor at most
MAX_VOCAB = 5_000_000
#: characters of the pieces that a worker remembers the ids of
_MEMORY = 1 << 21
#: characters of the longest piece that is encoded together with others
_SHORT = 64

VOCAB_SCHEMA = "token_id int, token string, kind string, left string, right string, count long"


def merge_runs(runs: list[tuple[list[str], int]], least: int, tokens: set[str], most: int) -> list[tuple[str, str, int]]:
    """The merges (left, right, count) of weighted symbol runs, most frequent first, down to
    a count of ``least``; ``most`` of them at most. ``tokens`` are never made anew, and get
    those that are made."""
    words, weight = [list(r) for r, _ in runs], [n for _, n in runs]
    count: Counter = Counter()
    holders: dict[tuple[str, str], set[int]] = {}
    for i, (w, n) in enumerate(zip(words, weight, strict=True)):
        for p in zip(w, w[1:], strict=False):
            count[p] += n
            holders.setdefault(p, set()).add(i)
    heap = [(-c, *p) for p, c in count.items() if c >= least]
    heapq.heapify(heap)
    merges = []
    while heap and len(merges) < most:
        c, a, b = heapq.heappop(heap)
        now = count[a, b]
        if now != -c:  # it has lost occurrences since: back to its place
            if now >= least:
                heapq.heappush(heap, (-now, a, b))
            continue
        made = a + b
        if made in tokens:
            continue
        tokens.add(made)
        merges.append((a, b, now))
        fresh = set()
        for i in holders.pop((a, b)):
            w, n = words[i], weight[i]
            for p in zip(w, w[1:], strict=False):
                count[p] -= n
            out, k, last = [], 0, len(w) - 1
            while k <= last:
                if k < last and w[k] == a and w[k + 1] == b:
                    out.append(made)
                    k += 2
                else:
                    out.append(w[k])
                    k += 1
            words[i] = out
            for p in zip(out, out[1:], strict=False):
                count[p] += n
                if made in p:
                    holders.setdefault(p, set()).add(i)
                    fresh.add(p)
        for p in fresh:
            if count[p] >= least:
                heapq.heappush(heap, (-count[p], *p))
    return merges


def apply_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols after all merges, the lowest rank first, each from left to right."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        j = after[k]
        # the pair that was put here may be gone: its rank tells
        if symbols[k] is None or j >= n or ranks.get((symbols[k], symbols[j])) != r:
            continue
        symbols[k] += symbols[j]
        symbols[j] = None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (x := ranks.get((symbols[k], symbols[after[k]]))) is not None:
                heapq.heappush(heap, (x, k))
        if before[k] >= 0 and (x := ranks.get((symbols[before[k]], symbols[k]))) is not None:
            heapq.heappush(heap, (x, before[k]))
    return [s for s in symbols if s is not None]


#: symbols: code points, and from here on merges in their order
_FIRST_MERGE = 0x110000
#: symbols that a block of pieces is filled up to, and pairs or runs that a task holds before it sends their sums on
_BLOCK, _HELD = 1 << 20, 1 << 18
_BLOCK_SCHEMA = "symbols binary, sizes binary, counts binary"


def _name(symbol: int, made: list[str]) -> str:
    return chr(symbol) if symbol < _FIRST_MERGE else made[symbol - _FIRST_MERGE]


def _block(symbols: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([x.tobytes()], pa.binary()) for x in (symbols, sizes, counts)]
    return pa.RecordBatch.from_arrays(cells, ["symbols", "sizes", "counts"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n) as blocks: the symbols of all pieces, how many each has, and its count."""
    texts, counts, size = [], [], 0

    def block():
        symbols = np.frombuffer("".join(texts).encode("utf-32-le"), "<i4")
        return _block(symbols, np.fromiter(map(len, texts), np.int64, len(texts)), np.concatenate(counts))

    for b in batches:
        texts += b.column(0).to_pylist()
        counts.append(b.column(1).to_numpy())
        size += sum(map(len, texts[len(texts) - b.num_rows:]))
        if size >= _BLOCK:
            yield block()
            texts, counts, size = [], [], 0
    if texts:
        yield block()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for row in zip(*b.columns, strict=True):
            yield tuple(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<i4", "<i8", "<i8"), strict=True))


def _pairs_of(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with the next one, as a number, and whether both are of one piece."""
    inside = np.ones(max(0, len(symbols) - 1), bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    return symbols[:-1].astype(np.int64) << 32 | symbols[1:], inside


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(_FIRST_MERGE, bool)
    for symbols, _, _ in _unpacked(batches):
        seen[symbols] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], ["c"])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def total():
        return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def rows(pairs, counts):
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["p", "c"])

    for symbols, sizes, counts in _unpacked(batches):
        pairs, inside = _pairs_of(symbols, sizes)
        held.append(_summed(pairs[inside], np.repeat(counts, sizes - 1)))
        size += len(held[-1][0])
        if size > 16 * _HELD:
            held = [total()]
            size = len(held[0][0])
            if size > 8 * _HELD:
                yield rows(*held[0])
                held, size = [], 0
    if held:
        yield rows(*total())


def _pair_counts(words: DataFrame) -> DataFrame:
    return words.mapInArrow(_count_pairs, "p long, c long").groupBy("p").agg(F.sum("c").alias("c"))


def _strong_runs(symbols: np.ndarray, sizes: np.ndarray, strong: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and end of every run of symbols that strong pairs (sorted) join, and the piece it is in."""
    pairs, inside = _pairs_of(symbols, sizes)
    place = np.minimum(np.searchsorted(strong, pairs), len(strong) - 1)
    step = np.diff((inside & (strong[place] == pairs)).astype(np.int8), prepend=0, append=0)
    first = np.flatnonzero(step == 1)
    return first, np.flatnonzero(step == -1) + 1, np.searchsorted(np.cumsum(sizes), first, side="right")


def _runs_of(strong):
    def rows(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                          ["run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for symbols, sizes, counts in _unpacked(batches):
            first, end, piece = _strong_runs(symbols, sizes, strong.value)
            data = symbols.tobytes()
            for a, b, n in zip((4 * first).tolist(), (4 * end).tolist(), counts[piece].tolist(), strict=True):
                key = data[a:b]
                found[key] = found.get(key, 0) + n
            if len(found) > _HELD:
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    return run


def _merged(shared):
    """Blocks after the merges of a round, each distinct run merged once in a task; pieces of one
    symbol have no more pairs and are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong, made, ranks = shared.value
        number = {t: _FIRST_MERGE + i for i, t in enumerate(made)}
        known: dict[bytes, bytes] = {}

        def merged(key: bytes) -> bytes:
            names = apply_merges([_name(s, made) for s in np.frombuffer(key, "<i4").tolist()], ranks)
            return np.array([ord(t) if len(t) == 1 else number[t] for t in names], "<i4").tobytes()

        for symbols, sizes, counts in _unpacked(batches):
            first, end, piece = _strong_runs(symbols, sizes, strong)
            data, at, parts, less = symbols.tobytes(), 0, [], []
            for a, b in zip((4 * first).tolist(), (4 * end).tolist(), strict=True):
                key = data[a:b]
                new = known.get(key)
                if new is None:
                    if len(known) > _HELD:
                        known.clear()
                    new = known[key] = merged(key)
                parts += (data[at:a], new)
                less.append(len(key) - len(new))
                at = b
            parts.append(data[at:])
            sizes = sizes.copy()
            np.subtract.at(sizes, piece, np.array(less, np.int64) // 4)
            symbols, open_ = np.frombuffer(b"".join(parts), "<i4"), sizes > 1
            if open_.any():
                yield _block(symbols[np.repeat(open_, sizes)], sizes[open_], counts[open_])

    return run


def learn_bpe(counts: DataFrame, vocab_size: int = 42_000, min_frequency: int = 2, num_merges: int | None = None,
              max_runs: int = MAX_RUNS) -> DataFrame:
    """K2: the vocabulary of a (piece, n) table: (token_id, token, kind, left, right, count).

    Ids: the special tokens, 256 byte tokens, the characters that occur (by code point;
    all of them), then merges until ``vocab_size`` tokens (or ``num_merges`` merges, if
    given) or until no pair is left with ``min_frequency`` occurrences. Pieces that are null or empty are left out; rows of one
    piece add up; other columns are ignored. An empty table gives the first 261 tokens.
    """
    spark = counts.sparkSession
    pieces = (counts.where("piece IS NOT NULL AND piece <> ''").groupBy("piece")
              .agg(F.coalesce(F.sum("n").cast("long"), F.lit(0)).alias("n")))
    words = cut_lineage(pieces.select(F.make_valid_utf8("piece").alias("piece"), "n").mapInArrow(_packed, _BLOCK_SCHEMA))
    sc = spark.sparkContext
    # the characters of Unicode at most
    alphabet = [chr(r.c) for r in words.mapInArrow(_characters, "c int").distinct().sort("c").collect()]
    base = [*SPECIALS, *(f"<0x{b:02X}>" for b in range(256))]
    fixed = [(t, "special" if i < len(SPECIALS) else "byte") for i, t in enumerate(base)]
    fixed += [(c, "character") for c in alphabet]
    tokens = {t for t, _ in fixed}
    wanted = max(0, vocab_size - len(fixed)) if num_merges is None else num_merges
    merges: list[tuple[str, str, int]] = []
    made: list[str] = []
    take = 64
    while len(merges) < wanted:
        pairs = _pair_counts(words).where(F.col("c") >= min_frequency)
        while True:
            first = pairs.sort(F.desc("c"), "p").limit(take + 1).collect()
            whole = len(first) <= take
            # a pair whose string is a token may not merge, but it joins runs all the same
            top = next((r.c for r in first
                        if _name(r.p >> 32, made) + _name(r.p & 0xFFFFFFFF, made) not in tokens), None)
            if whole or top is not None and top > first[-1].c:
                break
            take *= 4  # ties: as many pairs as have the highest count
        if top is None:
            break
        k, tried = len(first) if whole else len(first) - 1, 0
        while True:
            cut = min_frequency if k == len(first) else first[k].c + 1
            strong = np.array(sorted(r.p for r in first if r.c >= cut), np.int64)
            runs = words.mapInArrow(_runs_of(sc.broadcast(strong)), "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
            found = runs.limit(max_runs + 1).collect()
            tried += 1
            if len(found) <= max_runs:
                break
            k = next((x for x in (k // 4, k // 16, k // 64, 1) if 0 < x < k and first[x].c < top), 0)
            if not k:  # runs of the most frequent pairs alone are few distinct ones
                found = runs.collect()
                break
        runs = [([_name(s, made) for s in np.frombuffer(r.run, "<i4").tolist()], r.n) for r in found]
        new = merge_runs(runs, cut, tokens, wanted - len(merges))
        merges += new
        if cut == min_frequency or len(merges) >= wanted:
            break
        made += [a + b for a, b, _ in new]
        shared = sc.broadcast((strong, made, {(a, b): r for r, (a, b, _) in enumerate(new)}))
        words = cut_lineage(words.mapInArrow(_merged(shared), _BLOCK_SCHEMA))
        take = max(16, k) * (8 if tried == 1 and len(found) < max_runs // 16 else 2)
    rows = [(i, t, kind, None, None, None) for i, (t, kind) in enumerate(fixed)]
    rows += [(len(fixed) + i, a + b, "merge", a, b, c) for i, (a, b, c) in enumerate(merges)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def _merged_together(symbols: np.ndarray, sizes: np.ndarray, n: int, pairs: np.ndarray, ranks: np.ndarray,
                     made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (numbers below ``n``) of many pieces after all merges, and how many each piece has.
    A step merges, in every piece that still has a pair, all places of its pair of the least rank."""
    none = len(pairs)

    def rank(at: np.ndarray) -> np.ndarray:
        key = symbols[at].astype(np.int64) * n + symbols[at + 1]
        place = np.minimum(np.searchsorted(pairs, key), none - 1)
        return np.where(pairs[place] == key, ranks[place], none)

    who, out, total = np.arange(len(sizes)), [], np.zeros(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    rest = np.full(len(symbols), none, np.int32)  # the rank of a symbol with the next one
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    inside = np.flatnonzero(inside)
    rest[inside] = rank(inside)
    while len(who):
        first = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(rest, first)
        open_ = least < none
        if not open_.all():
            of = np.repeat(open_, sizes)
            out.append((who[~open_], sizes[~open_], symbols[~of]))
            symbols, rest, who, sizes, least = symbols[of], rest[of], who[open_], sizes[open_], least[open_]
            if not len(who):
                break
            first = np.cumsum(sizes) - sizes
        hit = rest == np.repeat(least, sizes)
        if (hit[1:] & hit[:-1]).any():  # of one symbol again and again every other pair, from the left
            at = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
            hit &= (at - start) % 2 == 0
        symbols[hit] = made[rest[hit]]
        keep = np.concatenate([[True], ~hit[:-1]])
        sizes = sizes - np.add.reduceat(hit, first, dtype=np.int64)
        symbols, rest = symbols[keep], rest[keep]
        at = np.flatnonzero(hit[keep])
        last = np.zeros(len(symbols), bool)
        ends = np.cumsum(sizes)
        last[ends - 1] = True
        rest[at[last[at]]] = none
        at = at[~last[at]]
        rest[at] = rank(at)
        before = np.flatnonzero(hit[keep]) - 1
        before = before[before >= 0]
        before = before[~last[before]]
        rest[before] = rank(before)
    if out:
        ids, sizes, symbols = (np.concatenate(x) for x in zip(*out, strict=True))
        total[ids] = sizes
        place = (np.cumsum(total) - total)[ids] - (np.cumsum(sizes) - sizes)
        placed = np.empty_like(symbols)
        placed[np.arange(len(symbols)) + np.repeat(place, sizes)] = symbols
        symbols = placed
    return symbols, total


class Encoder:
    """Ids of texts by a vocabulary from ``learn_bpe``; one per worker, with the ids of
    the pieces it has met."""

    def __init__(self, vocab: list[tuple[int, str, str | None, str | None]]):
        self.ids = {token: i for i, token, _, _ in vocab if i >= FIRST_PIECE_ID}
        merges = sorted((i, a, b) for i, _, a, b in vocab if a is not None)
        self.ranks = {(a, b): i for i, a, b in merges}
        self.memory: dict[str, array] = {}
        self._held = 0
        self._pieces = re.compile(PY_PIECE_RE)
        self._together = self._numbered([(a, b) for _, a, b in merges])

    def _numbered(self, merges: list[tuple[str, str]]) -> tuple[np.ndarray, ...] | None:
        """Symbols as numbers: that of each character and the token of each, pairs (sorted) with their
        ranks, and what a rank makes. None if a merge comes before one that makes a part of it: only
        by the others can pieces be merged together, each by its pair of the least rank."""
        merges = list(dict.fromkeys(reversed(merges)))[::-1]  # of equal pairs the last counts
        last = {a + b: r for r, (a, b) in enumerate(merges)}
        if not merges or any(last.get(s, -1) >= r for r, pair in enumerate(merges) for s in pair):
            return None
        number = {s: i for i, s in enumerate(dict.fromkeys([*self.ids, *(s for p in merges for s in p), *last]))}
        of_char = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                of_char[ord(s)] = i
        pairs = np.array([number[a] * len(number) + number[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        return (of_char, np.array([self.ids.get(s, -1) for s in number], np.int32), pairs[order], order.astype(np.int32),
                np.array([number[a + b] for a, b in merges], np.int32))

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        sizes = pc.utf8_length(pieces).to_numpy()
        alone = np.ones(len(pieces), bool)
        found, many = np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        if self._together and len(pieces):
            of_char, token, *merges = self._together
            symbols = of_char[np.frombuffer(_utf8(pieces)[1].tobytes().decode("utf-8").encode("utf-32-le"), "<i4")]
            first = np.cumsum(sizes) - sizes
            alone = (sizes > _SHORT) | (np.minimum.reduceat(symbols, first) < 0)
            symbols, many[~alone] = _merged_together(symbols[np.repeat(~alone, sizes)], sizes[~alone], len(token), *merges)
            found = token[symbols]
            if found.min(initial=0) < 0:  # a symbol that is no token
                odd = np.zeros(len(pieces), bool)
                odd[np.repeat(np.arange(len(pieces)), many)[found < 0]] = True
                found = found[~np.repeat(odd, many)]
                alone |= odd
        if not alone.any():
            return found, many
        single = [self.piece(p) for p in pieces.filter(pa.array(alone)).to_pylist()]
        many[alone] = [len(x) for x in single]
        ids = np.empty(many.sum(), np.int32)
        ids[np.repeat(alone, many)] = np.frombuffer(b"".join(single), np.int32)
        ids[np.repeat(~alone, many)] = found
        return ids, many

    def piece(self, piece: str) -> array:
        found = self.memory.get(piece)
        if found is None:
            found = array("i")
            for s in apply_merges(list(piece), self.ranks):
                i = self.ids.get(s)
                found.extend([i] if i is not None else (BYTE_BASE + b for b in s.encode("utf-8", "surrogatepass")))
            if len(piece) <= _MEMORY >> 6:
                self._held += len(piece) + 1
                if self._held > _MEMORY:
                    self.memory.clear()
                    self._held = len(piece) + 1
                self.memory[piece] = found
        return found

    def text(self, text: str, max_len: int | None, add_bos: bool) -> array:
        ids = array("i", [BOS] if add_bos else [])
        for m in self._pieces.finditer(text.replace(" ", METASPACE)):
            ids += self.piece(m.group())
            if max_len is not None and len(ids) >= max_len:
                return ids[:max_len]
        return ids


def _vocab_rows(vocab: DataFrame, *columns: str) -> list[tuple]:
    rows = vocab.select(*columns).limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_VOCAB} tokens is too large to send to every executor")
    return [tuple(r) for r in rows]


def encode(df: DataFrame, key: str, text_col: str, vocab: DataFrame, max_len: int | None = 4096,
           add_bos: bool = True) -> DataFrame:
    """K3: (key, input_ids) by ranked merges with byte fallback, ``<bos>`` first, cut at
    ``max_len`` ids (None: whole). A null text is empty; repeated rows are kept."""
    shared = df.sparkSession.sparkContext.broadcast(_vocab_rows(vocab, "token_id", "token", "left", "right"))

    def coder():
        encoder = Encoder(shared.value)
        return encoder.pieces, lambda text: encoder.text(text, max_len, add_bos)

    return encode_texts(df, key, text_col, coder, max_len, add_bos)


def decode(df: DataFrame, key: str, ids_col: str, vocab: DataFrame) -> DataFrame:
    """(key, text) of token ids: special tokens are left out, runs of byte tokens become
    their UTF-8 text, a metaspace a space. Null ids give an empty text; an id that is no
    token raises."""
    shared = df.sparkSession.sparkContext.broadcast(_vocab_rows(vocab, "token_id", "token"))
    held: list[list[bytes]] = []

    @F.pandas_udf(T.StringType())
    def text(rows: pd.Series) -> pd.Series:
        if not held:
            table = [b""] * (1 + max(i for i, _ in shared.value))
            for i, t in shared.value:
                table[i] = b"" if i < BYTE_BASE else bytes([i - BYTE_BASE]) if i < FIRST_PIECE_ID else t.encode("utf-8")
            held.append(table)
        get = held[0].__getitem__
        return pd.Series([b"".join(map(get, r)).decode("utf-8", "replace").replace(METASPACE, " ") for r in rows])

    return spread(df.select(key, ids_col)).select(
        key, text(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).alias("text"))
