"""Token counts: pieces counted once per distinct pre-token, joined to the
documents' pre-token frequencies and summed; no ids are kept.

A text is cut before every space that a non-space follows. A byte-level
tokenizer always starts a new pre-token there, whatever stands on either side,
so the pieces of the parts add up to the pieces of the text, special strings
included (they hold no space). Each block of documents sends a shard its
distinct parts with the documents that hold them (``common``); the shard has the
library count every distinct part once and returns, for each block, the sums of
the documents that hold any of its parts. A part that many documents of a block hold
goes to a shard chosen by part and block, so no shard gets all postings of a frequent
part; each block's postings of a part stay together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Ids, blocks, distinct, documents_view, pack, shards_for, starts, unpack

_ROUTED = "shard int, payload binary"
_PARTIAL = "block long, sums binary"
#: a space that another white space precedes or follows, or that ends the text
_ODD_SPACE = re.compile(r" (?:\s|$)")
_BEFORE_WORD = re.compile(r" (?=\S)")
#: a part is hot in a block if more than one in HOT of its documents hold it
HOT = 64
#: (pre-token, document) entries hold at most this many occurrences each
_MOST = 65535


def library_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of strings as the ``tokenizers`` file at ``path`` gives them."""
    loaded: list = []

    def count(parts: list[str]) -> list[int]:
        if not loaded:
            import os
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            loaded.append(tok)
        return [len(e.ids) for e in loaded[0].encode_batch_fast(parts, add_special_tokens=False)]

    return count


def split_parts(text: str) -> list[str]:
    """Parts whose token counts add up to the text's; empty for an empty text."""
    if not text:
        return []
    words = text.split(" ") if _ODD_SPACE.search(text) is None else _BEFORE_WORD.split(text)
    out = [" " + w for w in words]
    out[0] = words[0]
    return out if out[0] else out[1:]


def _route(n_shards: int):
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("payload", pa.binary())])
        for b in blocks(batches):
            ids = Ids()
            part, doc, times = [], [], []
            for slot, text in enumerate(b.texts):
                for p, n in Counter(split_parts(text.decode("utf-8", "replace"))).items():
                    u = ids[p]
                    while n > 0:
                        part.append(u)
                        doc.append(slot)
                        times.append(min(n, _MOST))
                        n -= _MOST
            parts = [p.encode("utf-8", "surrogatepass") for p in ids]
            crc = np.fromiter((zlib.crc32(p) for p in parts), np.int64, len(parts))
            part, doc, times = np.array(part, np.int64), np.array(doc, np.uint16), np.array(times, np.uint16)
            # a part that many documents hold is dealt by block too: its postings spread over all
            # shards, each of which counts it once
            hot = np.bincount(part, minlength=len(parts)) * HOT > len(b.texts)
            salt = zlib.crc32(b.number.to_bytes(8, "little"))
            shard_of = (crc + np.where(hot, salt, 0)) % n_shards
            order = np.argsort(shard_of, kind="stable")
            rank = np.empty(len(parts), np.int64)
            rank[order] = np.arange(len(parts))
            by_rank = np.argsort(rank[part], kind="stable")
            part, doc, times = rank[part][by_rank], doc[by_rank], times[by_rank]
            cut = np.searchsorted(shard_of[order], np.arange(n_shards + 1))
            cut_post = np.searchsorted(part, cut)
            home = (b.number ^ (b.number >> 32)) % n_shards
            shards, payloads = [], []
            for s in range(n_shards):
                lo, hi = int(cut[s]), int(cut[s + 1])
                if lo == hi and s != home:
                    continue
                a, z = int(cut_post[s]), int(cut_post[s + 1])
                mine = [parts[i] for i in order[lo:hi]]
                meta_ids = b.ids if s == home else []
                meta_len = [len(t) for t in b.texts] if s == home else []
                payloads.append(pack(
                    np.array([b.number], np.int64),
                    np.fromiter(map(len, mine), np.uint32, len(mine)), np.frombuffer(b"".join(mine), np.uint8),
                    np.bincount(part[a:z] - lo, minlength=hi - lo).astype(np.uint32), doc[a:z], times[a:z],
                    np.array([x or 0 for x in meta_ids], np.int64),
                    np.array([x is None for x in meta_ids], np.uint8), np.array(meta_len, np.int64)))
                shards.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())],
                                             schema=schema)

    return run


def _count(count: Callable[[list[str]], list[int]]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks_in = [unpack(p, np.int64, np.uint32, np.uint8, np.uint32, np.uint16, np.uint16,
                            np.int64, np.uint8, np.int64) for p in rows["payload"]]
        ids, index = Ids(), []
        for _, sizes, raw, *_rest in blocks_in:
            at, data = starts(sizes).tolist(), raw.tobytes()
            index.append(np.fromiter(map(ids.__getitem__, [data[a:z] for a, z in zip(at, at[1:], strict=False)]),
                                     np.int64, len(sizes)))
        parts = list(ids)
        pieces = np.empty(len(parts), np.int64)
        for i in range(0, len(parts), 20000):
            pieces[i:i + 20000] = count([p.decode("utf-8", "surrogatepass") for p in parts[i:i + 20000]])
        out = []
        for (number, _s, _r, holders, doc, times, meta, null, n_bytes), mine in zip(blocks_in, index, strict=True):
            worth = np.bincount(doc, np.repeat(pieces[mine], holders) * times.astype(np.int64))
            slot = distinct(doc)
            out.append((int(number[0]), pack(slot, worth[slot].astype(np.uint32), meta, null, n_bytes)))
        return pd.DataFrame(out, columns=["block", "sums"])

    return run


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block, from what each shard found in them."""
    got = [unpack(p, np.uint16, np.uint32, np.int64, np.uint8, np.int64) for p in rows["sums"]]
    ids, null, n_bytes = next((g[2:] for g in got if len(g[2])), got[0][2:])
    total = np.zeros(len(ids), np.int64)
    for slot, n, *_ in got:
        total[slot] += n
    return pd.DataFrame({"id": pd.array([None if x else i for i, x in zip(ids.tolist(), null, strict=True)], "Int64"),
                         "n_bytes": n_bytes, "n_tokens": total})


def token_counts(docs: DataFrame, count: Callable[[list[str]], list[int]], id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512, n_shards: int | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``count`` gives the token counts of a list of strings (``library_counter``).
    A null text is empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows
    are counted each. Other columns are ignored. An empty table gives no rows.
    Nothing is cut: a long text is one document with more parts.
    """
    view = documents_view(docs, id_col, text_col)
    n = n_shards or shards_for(view)
    routed = view.mapInArrow(_route(n), _ROUTED)
    partial = routed.groupBy("shard").applyInPandas(_count(count), _PARTIAL)
    total = partial.groupBy("block").applyInPandas(_gather, "id long, n_bytes long, n_tokens long")
    return total.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                        (F.col("n_tokens") > limit).alias("over_limit"))
