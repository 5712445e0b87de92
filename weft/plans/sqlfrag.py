"""DuckDB SQL fragments used by the oracle queries (same semantics as the
Spark column functions in ``weft.functions``)."""

from weft.functions.text import PY_WHITESPACE

STRIP_SQL = rf"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+\z"
SPLIT_SQL = rf"[{PY_WHITESPACE}]+"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP_SQL}', '', 'g')"


def clean(expr: str) -> str:
    s = strip(expr)
    return (f"(CASE WHEN {expr} IS NULL THEN '' WHEN lower({s}) IN "
            f"('[deleted]','[removed]','deleted','removed') THEN '' ELSE {s} END)")


def row_id(source: str, text: str) -> str:
    return f"sha256({source} || chr(0) || {text})"


def hex_mod100(hexexpr: str) -> str:
    return f"(('0x' || substr({hexexpr}, 1, 16))::UBIGINT % 100)"


def hash_split(idexpr: str) -> str:
    return f"(CASE WHEN {hex_mod100(idexpr)} < 2 THEN 'validation' ELSE 'train' END)"


def words(expr: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array({expr}, '{SPLIT_SQL}'), "
            f"lambda x: x <> '')) AS BIGINT)")


def order_key(seed, *cols: str) -> str:
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"sha256('{seed}:' || {parts})"


# Unique non-empty cleaned documents with ids, first row per id by doc_id.
CORPUS_ROWS = f"""
corpus_rows AS (
  SELECT doc_id, source, text, lang, id FROM (
    SELECT doc_id, source, text, lang, {row_id('source', 'text')} AS id,
           row_number() OVER (PARTITION BY {row_id('source', 'text')} ORDER BY doc_id) AS rn
    FROM (SELECT doc_id, source, lang, {clean('text')} AS text FROM documents)
    WHERE text <> '')
  WHERE rn = 1)
"""
