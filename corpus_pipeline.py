"""Corpus pipeline over the training-data operators; each stage is written as
Parquet and read again as the next stage's documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.chosen_path import one_of_each
from weft.llm.common import kept, prepare
from weft.llm.contamination import decontaminate
from weft.llm.importance import select_documents
from weft.llm.piece_scan import encode_ids
from weft.llm.surrogates import replace_entities

#: key of the surrogates; a production run gives a secret one
SURROGATE_KEY = "example"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards the good labelled ones."""
    return select_documents(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates."""
    prepare(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data and secrets."""
    prepare(spark)
    made = replace_entities(docs, SURROGATE_KEY).drop("n_entities")
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document: doc_id, lang, source, n_pieces, piece_ids (32-bit little-endian)."""
    import public_tokenizers
    prepare(spark)
    encoded = encode_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"),
                          "piece_ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("private_data", private_data), ("pieces", pieces)]

#: the stages sample, search, draw surrogates and encode by methods that SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of ``sf_dir`` in order."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
