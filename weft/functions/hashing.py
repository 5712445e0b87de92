"""Stable identifiers and hash-based assignment.

All built on ``sha2``/``conv`` so values are identical in Spark, DuckDB and
Python and independent of partitioning.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = "\u0000"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stable_row_id(source: str | Column, text: str | Column) -> Column:
    """Hex SHA-256 of ``source NUL text``."""
    return F.sha2(F.concat(_c(source), F.lit(NUL), _c(text)), 256)


def cache_key(dataset: str | Column, text: str | Column) -> Column:
    """Same construction keyed by dataset name."""
    return stable_row_id(dataset, text)


def hex64_mod(hex_col: str | Column, modulus: int) -> Column:
    """Unsigned value of the first 16 hex digits, modulo ``modulus``.

    Done on two 32-bit halves in bigint arithmetic: exact, and no decimal.
    """
    h = _c(hex_col)
    hi = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
    two32 = (1 << 32) % modulus
    return ((hi % modulus) * two32 + lo % modulus) % modulus


def hash_split(id_col: str | Column, holdout_pct: int = 2,
               holdout: str = "validation", rest: str = "train") -> Column:
    """First 64 bits of the id modulo 100 below ``holdout_pct`` -> hold-out."""
    return F.when(hex64_mod(id_col, 100) < holdout_pct, F.lit(holdout)).otherwise(F.lit(rest))


def text_hash_bucket(text: str | Column) -> Column:
    """B7 default: bucket 0..99 from SHA-256 of the text alone."""
    return hex64_mod(F.sha2(_c(text), 256), 100)


@F.pandas_udf(T.IntegerType())
def blake2b_bucket(s: pd.Series) -> pd.Series:
    """B7 exact mode: BLAKE2b-64 of the UTF-8 text, big-endian, modulo 100."""
    def one(t):
        d = hashlib.blake2b(t.encode("utf-8"), digest_size=8).digest()
        return int.from_bytes(d, "big") % 100
    return s.map(one).astype("int32")


def text_hash_split(text: str | Column, holdout_pct: int = 2, exact: bool = False,
                    holdout: str = "eval", rest: str = "train") -> Column:
    """Hold out ``holdout_pct`` percent by a hash of the text only."""
    bucket = blake2b_bucket(_c(text)) if exact else text_hash_bucket(text)
    return F.when(bucket < holdout_pct, F.lit(holdout)).otherwise(F.lit(rest))


def seeded_order_key(seed: int | str, *cols: str | Column) -> Column:
    """Deterministic shuffle key: ``sha2(seed ':' key)`` (never ``rand``)."""
    parts = [F.lit(f"{seed}:")]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(_c(c).cast("string"))
    return F.sha2(F.concat(*parts), 256)
