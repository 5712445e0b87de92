"""Registered queries of the training-data operators: one thin query per
operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import contamination, divergence
from weft.llm.common import prepare
from weft.session import table

#: n-grams of the registered language model
NGRAM_ORDER = 3

#: key of the registered query; a caller gives a secret one
SURROGATE_KEY = "example"

QUERIES: dict = {}
ORACLE: dict = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, name)


@register
def op1_ngram_trie(spark, sf_dir):
    from weft.llm.ngram_trie import ngram_scores
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return ngram_scores(docs, remainder != 0, order=NGRAM_ORDER)


@register
def op2_repeated_spans(spark, sf_dir):
    from weft.llm.repeated_spans import digest, remove_repeated
    return digest(remove_repeated(_table(spark, sf_dir, "documents"), length=35))


@register
def op3_token_counts(spark, sf_dir):
    from weft.llm.token_counts import library_counter, token_counts
    docs = _table(spark, sf_dir, "documents")
    return token_counts(docs, library_counter(_tokenizer("byte_bpe_50k.json")), limit=512)


@register
def op4_importance(spark, sf_dir):
    from weft.llm.importance import importance_sample
    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


@register
def op5_vector_links(spark, sf_dir):
    from weft.llm.vector_links import vector_links
    return vector_links(_table(spark, sf_dir, "embeddings"), threshold=0.98)


@register
def op6_surrogates(spark, sf_dir):
    from weft.llm.surrogates import replace_entities
    made = replace_entities(_table(spark, sf_dir, "documents"), key=SURROGATE_KEY)
    return made.select("doc_id", "text", "n_entities")


@register
def op7_piece_scan(spark, sf_dir):
    from weft.llm import piece_scan
    model = _tokenizer("piece_bpe_32k.model")
    encoded = piece_scan.encode_ids(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return piece_scan.digest(piece_scan.decode_ids(encoded, model))


@register
def op8_contamination(spark, sf_dir):
    found = contamination.containment(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


ORACLE["op8_contamination"] = contamination.ORACLE_SQL


@register
def op9_packed_ids(spark, sf_dir):
    from weft.llm.packed_ids import LibraryEncoder, packed_ids
    docs = _table(spark, sf_dir, "documents")
    rows = packed_ids(docs, LibraryEncoder(_tokenizer("word_bpe_49k.json")), vocab_size=49408, end_id=1)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@register
def op10_chosen_path(spark, sf_dir):
    from weft.llm.chosen_path import ngram_join
    return ngram_join(_table(spark, sf_dir, "documents")).drop("row", "group", "text_hash")


@register
def op11_divergence(spark, sf_dir):
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


ORACLE["op11_divergence"] = divergence.ORACLE_SQL


@register
def op12_turn_repair(spark, sf_dir):
    from weft.llm.turn_repair import damage, digest, repair_turns
    conversations = _table(spark, sf_dir, "conversations")
    return digest(repair_turns(damage(conversations)), conversations)


@register
def op13_main_text(spark, sf_dir):
    from weft.llm.main_text import extract_pages
    return extract_pages(_table(spark, sf_dir, "pages"))
