"""Text to tokens, distributed core (K1, K3-K5, D14 input).

Pre-tokenization is one regex over the metaspace-normalized text; the
vocabulary is the top pieces by count (a bounded table, broadcast); unknown
pieces fall back to byte tokens. Packing moves each token array
once, to its batch of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import _c
from weft.session import spread

# Special tokens in id order, then 256 byte tokens <0x00>..<0xFF>.
SPECIALS = ("<unk>", "<bos>", "<eos>", "<pad>", "<mask>")
UNK, BOS, EOS, PAD, MASK = range(5)
BYTE_BASE = len(SPECIALS)
FIRST_PIECE_ID = BYTE_BASE + 256
METASPACE = "▁"
# A piece: an optional metaspace and a run of other non-newline characters;
# else CRLF, a lone CR / LF, or a lone metaspace (possessive: no backtracking).
PIECE_RE = rf"{METASPACE}?+[^{METASPACE}\r\n]++|\r\n|[\r\n{METASPACE}]"
PY_PIECE_RE = rf"{METASPACE}?[^{METASPACE}\r\n]+|\r\n|[\r\n{METASPACE}]"
MAX_VOCAB_BROADCAST = 5_000_000
#: bytes of the texts that are cut into pieces at once; a longer text goes piece by piece
_TEXT_BYTES = 1 << 22
#: positions that are masked at once
_POSITIONS = 1 << 16


def pieces(text: str | Column) -> Column:
    """K1: spaces -> metaspace; newlines isolated; a metaspace starts a piece."""
    return F.regexp_extract_all(F.replace(_c(text), F.lit(" "), F.lit(METASPACE)), F.lit(PIECE_RE), 0)


def pretoken_counts(df: DataFrame, text_col: str) -> DataFrame:
    """K1: count of every piece (partial aggregate per piece)."""
    return (spread(df.select(text_col)).select(F.explode(pieces(text_col)).alias("piece"))
            .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))


def word_vocab(counts: DataFrame, vocab_size: int, min_frequency: int = 2) -> DataFrame:
    """Vocabulary of whole pieces: the most frequent (ties by piece) with at
    least ``min_frequency`` occurrences get ids after the specials and the
    byte tokens. A top-k take: each partition keeps its best, one merge."""
    n = max(0, vocab_size - FIRST_PIECE_ID)
    top = counts.filter(F.col("n") >= min_frequency).orderBy(F.desc("n"), F.asc("piece")).limit(n)
    w = Window.orderBy(F.desc("n"), F.asc("piece"))  # bounded: at most vocab_size rows
    return top.select("piece", (F.row_number().over(w) - 1 + FIRST_PIECE_ID).cast("int").alias("token_id"))


def byte_ids(piece: Column) -> Column:
    """UTF-8 bytes of a piece as byte-token ids."""
    hx = F.hex(F.encode(piece, "UTF-8"))
    return F.transform(F.regexp_extract_all(hx, F.lit(".."), 0),
                       lambda b: (F.conv(b, 16, 10).cast("int") + BYTE_BASE))


def encode_ids(df: DataFrame, key: str, text_col: str, vocab: DataFrame,
               max_len: int = 4096, add_bos: bool = True) -> DataFrame:
    """K3 (word level): text -> ids; unknown pieces -> byte tokens; <bos>
    first; cut at ``max_len``. Output (key, input_ids).

    The vocabulary (bounded by the vocabulary size, checked) is broadcast and
    the tasks look up the distinct pieces of some texts at a time, so pieces are
    never exploded into rows and no shuffle is needed. ``encode_ids_sql`` is the
    same operator in built-in SQL.
    """
    rows = vocab.limit(MAX_VOCAB_BROADCAST + 1).collect()  # one job, bounded
    if len(rows) > MAX_VOCAB_BROADCAST:
        raise ValueError(f"vocabulary of more than {MAX_VOCAB_BROADCAST} pieces is too large to broadcast")
    bc = df.sparkSession.sparkContext.broadcast({r["piece"]: int(r["token_id"]) for r in rows})
    rx = re.compile(PY_PIECE_RE)

    def known(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        get = bc.value.get
        ids = np.array([get(p, -1) for p in pieces.to_pylist()], np.int32)
        sizes, data = _utf8(pieces)
        flat = data.astype(np.int32) + BYTE_BASE
        whole = ids >= 0
        first = np.cumsum(sizes) - sizes
        flat[first[whole]] = ids[whole]
        left = np.repeat(~whole, sizes)
        left[first[whole]] = True
        return flat[left], np.where(whole, 1, sizes)

    def long(text: str) -> list[int]:
        ids = [BOS] if add_bos else []
        for m in rx.finditer(text.replace(" ", METASPACE)):
            i = bc.value.get(m.group())
            ids.extend([i] if i is not None else (b + BYTE_BASE for b in m.group().encode("utf-8")))
            if len(ids) >= max_len:
                break
        return ids[:max_len]

    return encode_texts(df, key, text_col, lambda: (known, long), max_len, add_bos)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text, and all of them."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.diff(ends), np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)


def cut_texts(texts: pa.Array, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of some texts, the place of each piece among them in the order of the
    texts, and how many pieces a text has; the first ``most`` pieces of a text only."""
    texts = pc.replace_substring(texts, " ", METASPACE)
    sizes, data = _utf8(texts)
    cr, lf = data == 0x0D, data == 0x0A
    starts = cr.copy()
    m = METASPACE.encode()
    starts[:-2] |= (data[:-2] == m[0]) & (data[1:-1] == m[1]) & (data[2:] == m[2])
    starts[1:] |= lf[:-1] | (cr[:-1] ^ lf[1:])  # after a line end or at one, but not inside CRLF
    ends = np.cumsum(sizes)
    starts[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, ends - sizes)
    counts = np.searchsorted(at, ends) - first
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    if counts.max(initial=0) > most:
        pieces = pieces.filter(pa.array(np.arange(len(at)) - np.repeat(first, counts) < most))
        counts = np.minimum(counts, most)
    coded = pieces.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def joined_ids(flat: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, head: list[int],
               most: int) -> pa.ListArray:
    """Ids of each text: ``head`` and those of its pieces (``cut_texts``), ``most`` at most."""
    n = sizes[places]
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[places] - ends[:-1], n)]
    last = np.concatenate([[0], np.cumsum(counts)])
    own = ends[last[1:]] - ends[last[:-1]]
    taken = np.minimum(own, max(0, most - len(head)))
    if (taken < own).any():
        ids = ids[np.arange(len(ids)) - np.repeat(ends[last[:-1]], own) < np.repeat(taken, own)]
    head = head[:most]
    out = np.concatenate([[0], np.cumsum(taken + len(head))])
    made = np.empty(out[-1], np.int32)
    rest = np.ones(len(made), bool)
    for i, x in enumerate(head):
        made[out[:-1] + i] = x
        rest[out[:-1] + i] = False
    made[rest] = ids
    return pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(made))


def encode_texts(df: DataFrame, key: str, text_col: str, coder, max_len: int | None, add_bos: bool) -> DataFrame:
    """(key, input_ids) of texts, null ones as empty. ``coder`` gives, once a task, two functions: the
    ids of an array of distinct pieces, one after the other, with their sizes; and those of a long text."""
    most, head = 1 << 62 if max_len is None else max_len, [BOS] if add_bos else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for b in batches:
            known, long = made = made or coder()
            size = pc.binary_length(b.column(1)).to_numpy()
            lo = 0
            while lo < b.num_rows:
                total = np.cumsum(size[lo:lo + (1 << 14)])
                rows = max(1, int(np.searchsorted(total, _TEXT_BYTES, side="right")))
                part = b.slice(lo, rows)
                if size[lo] > _TEXT_BYTES:
                    ids = pa.array([long(part.column(1)[0].as_py())], pa.list_(pa.int32()))
                else:
                    pieces, places, counts = cut_texts(part.column(1), most)
                    ids = joined_ids(*known(pieces), places, counts, head, most)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "input_ids"])
                lo += rows

    texts = spread(df.select(key, text_col)).select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.mapInArrow(run, T.StructType([df.schema[key], T.StructField("input_ids", T.ArrayType(T.IntegerType()))]))


def encode_ids_sql(df: DataFrame, key: str, text_col: str, vocab: DataFrame,
                   max_len: int = 4096, add_bos: bool = True) -> DataFrame:
    """K3 in built-in SQL: pieces exploded, joined to the
    vocabulary, ids gathered back per document in piece order."""
    ex = df.select(key, F.posexplode(pieces(text_col)).alias("pos", "piece"))
    joined = ex.join(vocab, "piece", "left")
    ids = F.when(F.col("token_id").isNotNull(), F.array(F.col("token_id"))).otherwise(byte_ids(F.col("piece")))
    per = joined.select(key, "pos", ids.alias("ids"))
    packed = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_s"))
    flat = F.flatten(F.transform("_s", lambda s: s["ids"]))
    if add_bos:
        flat = F.concat(F.array(F.lit(BOS)), flat)
    out = packed.select(key, F.slice(flat, 1, max_len).alias("input_ids"))
    # documents without any piece still get <bos>
    empty = df.select(key).join(out.select(key), key, "left_anti").select(
        key, (F.array(F.lit(BOS)) if add_bos else F.array().cast("array<int>")).alias("input_ids"))
    return out.unionByName(empty)


def _packed(block_len: int):
    """Blocks of one batch of documents: their tokens in order, an <eos> after each."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        ids = rows.column("input_ids").combine_chunks()
        n = np.diff(ids.offsets.to_numpy())
        flat = np.empty(int(n.sum()) + len(n), np.int32)
        ends = np.cumsum(n + 1) - 1
        own = np.ones(len(flat), bool)
        own[ends] = False
        flat[ends] = EOS
        flat[own] = ids.flatten().to_numpy()
        blocks = len(flat) // block_len
        cut = np.arange(0, (blocks + 1) * block_len, block_len, dtype=np.int32)
        return pa.table({"batch": pa.array([key[0].as_py()] * blocks, pa.int64()), "block": pa.array(range(blocks), pa.int64()),
                         "input_ids": pa.ListArray.from_arrays(cut, pa.array(flat[:blocks * block_len]))})

    return run


def pack_blocks(encoded: DataFrame, order_idx: str, block_len: int, batch_docs: int = 1000) -> DataFrame:
    """K4: inside batches of ``batch_docs`` documents (by ``order_idx``),
    join documents with <eos>, cut into blocks of ``block_len`` and drop the
    tail. Output (batch, block, input_ids, attention_mask).

    The tokens move once, to their batch, which is one group: at most ``batch_docs``
    documents of the length that the encoder cuts them to.
    """
    d = encoded.select(F.floor(F.col(order_idx) / batch_docs).cast("bigint").alias("batch"),
                       F.col(order_idx).cast("bigint").alias("_at"),
                       F.coalesce("input_ids", F.array().cast("array<int>")).alias("input_ids"))
    blocks = d.groupBy("batch").applyInArrow(_packed(block_len), "batch bigint, block bigint, input_ids array<int>")
    return blocks.withColumn("attention_mask", F.array_repeat(F.lit(1), block_len))


def _draws(keys: list, sizes: list[int], seed: int, tails: list[bytes]) -> np.ndarray:
    """Three numbers from 0 to 1 for every position of some blocks, from one digest each."""
    sha, out, at = hashlib.sha256, np.empty((sum(sizes), 3)), 0
    for key, n in zip(keys, sizes, strict=True):
        head = (f"{seed}:" if key is None else f"{seed}:{key}:").encode()
        for lo in range(0, n, _POSITIONS):
            digests = b"".join([sha(head + x).digest() for x in tails[lo:min(n, lo + _POSITIONS)]])
            drawn = np.frombuffer(digests, ">u4").reshape(-1, 8)[:, :3]
            out[at:at + len(drawn)] = drawn
            at += len(drawn)
    out /= float(16 ** 8)
    return out


def _drawn(vocab_size: int, prob: float, seed: int):
    """Blocks with their masked ``input_ids`` and ``labels``; the last column is the key. Some
    ``_POSITIONS`` positions at a time, a whole block at least."""
    def masked(b: pa.RecordBatch, sizes: np.ndarray, tails: list[bytes]) -> pa.RecordBatch:
        names = b.schema.names[:-1]
        at = names.index("input_ids")
        ids = b.column(at)
        flat = ids.flatten()
        t, known = flat.fill_null(0).to_numpy(), flat.is_valid().to_numpy(zero_copy_only=False)
        u = _draws(b.column(b.num_columns - 1).to_pylist(), sizes.tolist(), seed, tails)
        chosen = u[:, 0] < prob
        other = np.floor(u[:, 2] * vocab_size).astype(np.int32)
        new = np.where(u[:, 1] < 0.8, MASK, np.where(u[:, 1] < 0.9, other, t))
        # a position without an id gets one where it is chosen and replaced
        made = pa.array(np.where(chosen, new, t).astype(np.int32), mask=~known & ~(chosen & (u[:, 1] < 0.9)))
        labels = pa.array(np.where(chosen, t, -100).astype(np.int32), mask=~known & chosen)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        none = pa.array(ids.is_null().to_numpy(zero_copy_only=False))  # of a slice, from its own start
        lists = [pa.ListArray.from_arrays(pa.array(ends), x, mask=none) for x in (made, labels)]
        columns = [lists[0] if i == at else b.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, lists[1]], [*names, "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails: list[bytes] = []
        for b in batches:
            sizes = b.column(b.schema.names.index("input_ids")).value_lengths().fill_null(0).to_numpy()
            tails += [str(i).encode() for i in range(len(tails), int(sizes.max(initial=0)))]
            lo = 0
            while lo < b.num_rows:
                rows = max(1, int(np.searchsorted(np.cumsum(sizes[lo:lo + _POSITIONS], dtype=np.int64), _POSITIONS, side="right")))
                yield masked(b.slice(lo, rows), sizes[lo:lo + rows], tails)
                lo += rows

    return run


def mask_tokens(blocks: DataFrame, block_key: str, vocab_size: int, prob: float = 0.30,
                seed: int = 0) -> DataFrame:
    """K5: choose ``prob`` of the positions by a hash of (seed, block, pos);
    labels keep the chosen ids and are -100 elsewhere; chosen inputs become
    <mask> (80 %), a hashed random id (10 %) or stay (10 %). A position has one digest,
    of which the first three numbers of 32 bits decide."""
    ints = T.ArrayType(T.IntegerType())
    kinds = [T.StructField(f.name, ints if f.name == "input_ids" else f.dataType) for f in blocks.schema.fields]
    rows = blocks.withColumn("input_ids", F.col("input_ids").cast(ints)).withColumn("_key", F.col(block_key).cast("string"))
    return rows.mapInArrow(_drawn(vocab_size, prob, seed), T.StructType([*kinds, T.StructField("labels", ints)]))


def previous_token_predictions(ids: str | Column) -> Column:
    """A trivial predictor for D14 checks: each position predicts the
    previous input token (<bos> first)."""
    c = _c(ids)
    return F.concat(F.array(F.lit(BOS)), F.slice(c, 1, F.size(c) - 1))


# ------------------------------------------------------------------ BPE (K2)

_SEP = "\u0001"


def _lit_re(s: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in s)


def bpe_merges(counts: DataFrame, num_merges: int, min_frequency: int = 2,
               checkpoint_every: int = 5) -> DataFrame:
    """K2: byte-pair merges learned from a (piece, n) count table.

    Each round counts adjacent symbol pairs weighted by piece counts (one
    aggregate over the distinct pieces, not the text), takes the most
    frequent pair (ties by the pair's symbols) and merges it left to right
    without overlaps. At most ``num_merges`` rounds; stops early when no pair
    reaches ``min_frequency``. Output (rank, left, right, count).
    """
    from weft.session import cut_lineage
    spark = counts.sparkSession
    chars = F.regexp_extract_all(F.col("piece"), F.lit("(?s)."), 0)
    words = counts.select(F.concat(F.lit(_SEP), F.array_join(chars, _SEP), F.lit(_SEP)).alias("w"), "n")
    words = cut_lineage(words)  # the compact (piece, count) table, not the text, is iterated
    merges = []
    for r in range(num_merges):
        sym = F.split(F.expr(f"substring(w, 2, length(w) - 2)"), _SEP)
        pairs = (words.select("n", sym.alias("s"))
                 .select("n", F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"),
                                                      F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("p"))
                 .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("c")))
        best = (pairs.filter(F.col("c") >= min_frequency)
                .orderBy(F.desc("c"), F.asc("a"), F.asc("b")).limit(1).collect())
        if not best:
            break
        a, b, c = best[0]["a"], best[0]["b"], int(best[0]["c"])
        merges.append((r + 1, a, b, c))
        pat = f"{_SEP}{_lit_re(a)}{_SEP}{_lit_re(b)}(?={_SEP})"
        rep = (_SEP + a + b).replace("\\", "\\\\").replace("$", "\\$")
        words = words.withColumn("w", F.regexp_replace("w", pat, rep))
        if checkpoint_every and (r + 1) % checkpoint_every == 0:
            words = cut_lineage(words)
    return spark.createDataFrame(merges, "rank int, left string, right string, count long")
