"""Cached, batched transformation with a caller-supplied function.

The reference ran threads, queues and an HTTP client; here concurrency is
the partition count. Texts are de-duplicated and looked up in a cache table
first; only misses are batched (greedy, in order, by row and character
limits) and sent, batch by batch in the tasks, to a plain Python
callable. A failing batch is halved until single rows; a failing row moves
to the next client; errors become rows, never job failures. Results are
upserted into the cache (newest wins), so a re-run only fills misses.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.hashing import cache_key
from weft.functions.text import py_strip
from weft.operators.ordering import global_index, positions_in_group
from weft.session import cut_lineage

Client = Callable[[list[str]], list[str]]

# Rows per greedy-batching chunk, which is what one task holds.
CHUNK_ROWS = 100_000


def plan_pending(texts: DataFrame, text_col: str, cache: DataFrame, dataset: str) -> DataFrame:
    """L1: per distinct text: its cache key and status (blank / cached /
    pending) with the cached value. Distinct first, so each text is looked
    up (and later sent) once."""
    distinct = texts.select(F.col(text_col).alias("text")).distinct()
    keyed = distinct.withColumn("cache_key", cache_key(F.lit(dataset), "text"))
    joined = keyed.join(cache.select("cache_key", "translated_text"), "cache_key", "left")
    status = (F.when(py_strip(F.coalesce("text", F.lit(""))) == "", "blank")
              .when(F.col("translated_text").isNotNull(), "cached").otherwise("pending"))
    return joined.withColumn("status", status)


def _next_start(lengths: np.ndarray, batch_size: int, max_chars: int) -> np.ndarray:
    """For every row, the row that starts the next batch if a batch starts here."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    by_chars = np.searchsorted(total, total[:-1] + max_chars, side="right") - 1
    at = np.arange(len(lengths))
    return np.minimum(np.maximum(by_chars, at + 1), at + batch_size)


def _chunk_map(batch_size: int, max_chars: int, chunk_rows: int):
    """Where a chunk is left, and after how many batch starts, for each of the
    ``batch_size`` places at which the first batch of the chunk can start."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = int(pdf["_own"].sum())
        nxt = _next_start(pdf["_len"].to_numpy(np.int64), batch_size, max_chars).tolist()
        leave, n = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            j = nxt[i]
            leave[i], n[i] = (j - own, 1) if j >= own else (leave[j], n[j] + 1)
        k = min(batch_size, own)
        return pd.DataFrame({"_g": pdf["_g"].iloc[:1].to_list(), "_chunk": pdf["_chunk"].iloc[:1].to_list(),
                             "leave": [leave[:k]], "n": [n[:k]]})

    return run


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry place and first batch number of every chunk of one group, in order."""
    pdf = pdf.sort_values("_chunk")
    entry, base, out = 0, 0, []
    for g, c, leave, n in zip(pdf["_g"], pdf["_chunk"], pdf["leave"], pdf["n"]):
        out.append((g, c, entry, base))
        if entry < len(leave):
            entry, base = int(leave[entry]), base + int(n[entry])
        else:  # a last chunk that one batch covers to its end
            entry -= len(leave)
    return pd.DataFrame(out, columns=["_g", "_chunk", "entry", "base"])


def _number(batch_size: int, max_chars: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = int(pdf["_own"].sum())
        nxt = _next_start(pdf["_len"].to_numpy(np.int64), batch_size, max_chars)
        begins = np.zeros(own, np.int64)
        i = int(pdf["entry"].iloc[0])
        while i < own:
            begins[i] = 1
            i = int(nxt[i])
        batch = int(pdf["base"].iloc[0]) - 1 + np.cumsum(begins)
        mine = pdf.iloc[:own]
        return pd.DataFrame({"_g": mine["_g"], "_i": mine["_i"], "batch": batch})

    return run


def greedy_batches(df: DataFrame, order: Sequence[str], text_col: str, batch_size: int,
                   max_chars: int, group: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """consecutive rows, at most ``batch_size`` rows and ``max_chars`` characters
    per batch; an over-long row forms its own batch. Adds ``batch``, numbered from 0
    in each group; the same for any ``chunk_rows``.

    Rows are cut into chunks of consecutive positions. A batch that runs into a
    chunk covers fewer than ``batch_size`` of its rows, so a chunk is described by
    ``batch_size`` entry places and where each leaves it; these maps are composed
    in order (one small row per chunk), and then every chunk is numbered alone.
    Only positions and lengths enter Python.
    """
    g = list(group)
    chunk = max(chunk_rows, batch_size)
    idx = positions_in_group(df, g, list(order), "_i") if g else global_index(df, list(order), "_i")
    idx = idx.withColumn("_g", F.to_json(F.struct(*g)) if g else F.lit(""))
    narrow = idx.select("_g", "_i", F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("_len"))
    at = F.floor(F.col("_i") / chunk)
    # the first rows of a chunk are also seen by the chunk before, whose last batch they may end
    ahead = (F.pmod(F.col("_i"), F.lit(chunk)) < batch_size) & (at > 0)
    rows = narrow.withColumn("_c", F.explode(F.when(ahead, F.array(at, at - 1)).otherwise(F.array(at))))
    rows = rows.select("_g", "_i", "_len", F.col("_c").alias("_chunk"), (F.col("_c") == at).alias("_own"))
    rows = cut_lineage(rows)
    maps = rows.groupBy("_g", "_chunk").applyInPandas(
        _chunk_map(batch_size, max_chars, chunk), "_g string, _chunk long, leave array<int>, n array<long>")
    entries = maps.groupBy("_g").applyInPandas(_compose, "_g string, _chunk long, entry long, base long")
    numbered = rows.join(entries, ["_g", "_chunk"]).groupBy("_g", "_chunk").applyInPandas(
        _number(batch_size, max_chars), "_g string, _i long, batch long")
    return idx.join(numbered, ["_g", "_i"]).drop("_g", "_i")


def _call_with_retry(client: Client, texts: list[str], retries: int, backoff: float) -> list[str]:
    delay = backoff
    for attempt in range(retries + 1):
        try:
            out = client(texts)
            if not isinstance(out, list) or len(out) != len(texts):
                raise ValueError(f"expected {len(texts)} results, got {len(out) if isinstance(out, list) else type(out)}")
            if any(not isinstance(x, str) or not x.strip() for x in out):
                raise ValueError("missing result")
            return [x.strip() for x in out]
        except Exception:
            if attempt == retries:
                raise
            time.sleep(delay)
            delay *= 2
    raise AssertionError("unreachable")


def _translate(clients: Sequence[Client], keys: list[str], texts: list[str], retries: int,
               backoff: float, ci: int = 0) -> list[tuple[str, str | None, int, str | None]]:
    """Halve a failing batch until single rows; a failing single row goes to
    the next client. Returns (key, result, client index, error)."""
    try:
        res = _call_with_retry(clients[ci], texts, retries, backoff)
        return [(k, r, ci, None) for k, r in zip(keys, res)]
    except Exception as e:  # noqa: BLE001 - errors become data
        if len(texts) > 1:
            mid = len(texts) // 2
            return (_translate(clients, keys[:mid], texts[:mid], retries, backoff, ci)
                    + _translate(clients, keys[mid:], texts[mid:], retries, backoff, ci))
        if ci + 1 < len(clients):
            return _translate(clients, keys, texts, retries, backoff, ci + 1)
        return [(keys[0], None, ci, f"{type(e).__name__}: {e}")]


RESULT_SCHEMA = T.StructType([
    T.StructField("cache_key", T.StringType()), T.StructField("translated_text", T.StringType()),
    T.StructField("client", T.IntegerType()), T.StructField("error", T.StringType())])


def apply_batches(batches: DataFrame, clients: Sequence[Client], batch_col: str = "batch",
                  key_col: str = "cache_key", text_col: str = "text", retries: int = 2,
                  backoff: float = 0.05, group: Sequence[str] = ()) -> DataFrame:
    """L2: run every batch through the clients (fallback order), the rows of a batch in key
    order. The rows of a (``group`` columns, batch) lie one after the other in a task, which
    holds one batch at a time, bounded by the batching limits; batches of different groups
    never meet."""
    clients = list(clients)
    names = [*group, batch_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = None

        def sent() -> list[tuple]:
            return _translate(clients, [k for k, _ in held], [t for _, t in held], retries, backoff) if held else []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], RESULT_SCHEMA.names)

        for part in parts:
            done = []
            kinds = zip(*(part.column(i).to_pylist() for i in range(len(names))))
            for this, *row in zip(kinds, *(part.column(i).to_pylist() for i in (-2, -1))):
                if this != kind:
                    done += sent()
                    held, kind = [], this
                held.append(tuple(row))
            yield table(done)
        yield table(sent())

    rows = batches.select(*names, F.col(key_col).alias("_key"), F.col(text_col).alias("_text")).repartition(*names)
    return rows.sortWithinPartitions(*names, F.asc_nulls_last("_key")).mapInArrow(run, RESULT_SCHEMA)


def cache_upsert(cache: DataFrame, new: DataFrame, key_col: str = "cache_key",
                 ts_col: str = "created_at") -> DataFrame:
    """L3: the newest row per key wins (partial aggregate per key)."""
    cols = [c for c in cache.columns if c != key_col]
    u = cache.unionByName(new.select(*cache.columns))
    best = u.groupBy(key_col).agg(F.max_by(F.struct(*cols), F.col(ts_col)).alias("_r"))
    return best.select(key_col, *[F.col(f"_r.{c}").alias(c) for c in cols])


def restore_rows(rows: DataFrame, text_col: str, results: DataFrame, dataset: str,
                 out_col: str = "translated_text", only: Column | None = None,
                 on_missing: str = "error") -> DataFrame:
    """L4: attach results to every row (all columns kept); blank texts give ''.

    Rows for which ``only`` is not true (other configurations) pass through with
    their own text. A row without a result raises; ``on_missing="null"`` leaves it
    NULL, for ``missing_results``."""
    keyed = rows.withColumn("_k", cache_key(F.lit(dataset), text_col))
    res = results.select(F.col("cache_key").alias("_k"), F.col("translated_text").alias("_t"))
    blank = py_strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    value = F.col("_t")
    if on_missing == "error":
        value = F.coalesce(value, F.raise_error(F.concat(F.lit("no result for key "), F.coalesce("_k", F.lit("NULL"))))
                           .cast("string"))
    value = F.when(blank, F.lit("")).otherwise(value)
    if only is not None:
        value = F.when(F.coalesce(only, F.lit(False)), value).otherwise(F.col(text_col))
    return keyed.join(res, "_k", "left").withColumn(out_col, value).drop("_k", "_t")


def missing_results(restored: DataFrame, out_col: str = "translated_text") -> DataFrame:
    return restored.filter(F.col(out_col).isNull())

