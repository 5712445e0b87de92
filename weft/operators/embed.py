"""Text -> vector (H1).

Default encoder: signed feature hashing of lower-cased whitespace words
(SHA-256 of the word gives the bucket and the sign), summed per document:
built-in SQL, so it is checked against DuckDB. Any other encoder is a
caller-supplied factory, built once per task inside ``mapInPandas`` and fed
Arrow batches; the model itself is not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import SPLIT_RE

EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_embedding(df: DataFrame, key: str, text_col: str, dim: int = 64, prompt: str = "",
                     normalize: bool = False) -> DataFrame:
    """Signed feature hashing; (key, embedding array<double> of length dim).

    One row per (document, word) is hashed; per (document, bucket) sums are
    a partial aggregate, and a document gathers at most ``dim`` buckets.
    """
    text = F.lower(F.concat(F.lit(prompt), F.coalesce(F.col(text_col), F.lit(""))))
    words = df.select(key, F.explode(F.filter(F.split(text, SPLIT_RE), lambda w: w != "")).alias("w"))
    h = F.sha2("w", 256)
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = words.groupBy(key, bucket.alias("b")).agg(F.sum(sign).alias("v"))
    per = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)))
    out = df.select(key).join(per, key, "left").select(key, dense.alias("embedding"))
    if normalize:
        from weft.operators.vectors import l2_normalize
        out = out.withColumn("embedding", l2_normalize("embedding"))
    return out


def word_hash_encoder(dim: int) -> EncoderFactory:
    """A factory of the default encoder for use batch by batch: signed hashing of words."""
    def factory():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1.0 if h >> 31 else -1.0
            return out

        return encode

    return factory


def encoder_embedding(df: DataFrame, key: str, text_col: str, factory: EncoderFactory, dim: int,
                      prompt: str = "", normalize: bool = False) -> DataFrame:
    """Caller encoder: ``factory()`` -> ``encode(list[str]) -> (n, dim)``,
    built once per task; batches arrive via Arrow. Shapes are checked."""
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType(), False))])

    def run(it):
        encode = factory()
        for pdf in it:
            texts = [prompt + (t or "") for t in pdf[text_col].tolist()]
            vecs = np.asarray(encode(texts), dtype=np.float32) if texts else np.zeros((0, dim), np.float32)
            if vecs.shape != (len(texts), dim):
                raise ValueError(f"encoder returned shape {vecs.shape}, expected {(len(texts), dim)}")
            if normalize:
                n = np.linalg.norm(vecs, axis=1, keepdims=True)
                vecs = np.divide(vecs, n, out=np.zeros_like(vecs), where=n > 0)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "embedding": list(vecs)})

    return df.select(key, text_col).mapInPandas(run, schema)
