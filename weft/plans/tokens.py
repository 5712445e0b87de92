"""Registered token queries (K1, K3-K5, D14) and the pair-to-IR view."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import clean_text
from weft.operators import bpe as B
from weft.operators import profile as P
from weft.operators import tokens as K
from weft.operators.ordering import global_index
from weft.plans import sqlfrag as S
from weft.session import cut_lineage, table

QUERIES: dict = {}
ORACLE: dict = {}

VOCAB_SIZE = 8000
MAX_LEN = 4096
BLOCK_LEN = 1024
BATCH_DOCS = 1000
MASK_SEED = 0

_PIECES_SQL = r"regexp_extract_all(replace({t}, ' ', '▁'), '\r\n|\r|\n|▁?[^▁\r\n]+|▁', 0)"


def pretoken_counts(spark, sf):
    """K1: pieces and their counts over all cleaned documents."""
    d = table(spark, sf, "documents").select(clean_text("text").alias("text"))
    return K.pretoken_counts(d, "text")


QUERIES["pretoken_counts"] = pretoken_counts
_PC_SQL = f"""pc AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES_SQL.format(t=S.clean('text'))}) AS piece
                                                   FROM documents) GROUP BY piece)"""
ORACLE["pretoken_counts"] = f"WITH {_PC_SQL} SELECT * FROM pc"


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", clean_text("text").alias("text"))
    return d.filter(F.col("text") != "")


def _encoded(spark, sf):
    d = _docs(spark, sf)
    vocab = K.word_vocab(K.pretoken_counts(d, "text"), VOCAB_SIZE)
    return K.encode_ids(d, "doc_id", "text", vocab, MAX_LEN)


def encode_ids(spark, sf):
    """K3: word-level ids with byte fallback, <bos> first, cut at 4096."""
    return _encoded(spark, sf)


QUERIES["encode_ids"] = encode_ids
_ENC_SQL = f"""{_PC_SQL},
vocab AS (SELECT piece, CAST(row_number() OVER (ORDER BY n DESC, piece) - 1 + {K.FIRST_PIECE_ID} AS INTEGER) AS token_id
          FROM (SELECT * FROM pc WHERE n >= 2 ORDER BY n DESC, piece LIMIT {VOCAB_SIZE - K.FIRST_PIECE_ID})),
dd AS (SELECT doc_id, {_PIECES_SQL.format(t=S.clean('text'))} AS ps FROM documents WHERE {S.clean('text')} <> ''),
ex AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS pos FROM dd),
ids AS (SELECT doc_id, pos, CASE WHEN v.token_id IS NOT NULL THEN [v.token_id]
          ELSE list_transform(regexp_extract_all(hex(encode(ex.piece)), '..', 0),
                              lambda b: CAST(('0x' || b)::INTEGER + {K.BYTE_BASE} AS INTEGER)) END AS ids
        FROM ex LEFT JOIN vocab v USING (piece)),
enc AS (SELECT doc_id, list_concat([{K.BOS}], flatten(list(ids ORDER BY pos)))[1:{MAX_LEN}] AS input_ids
        FROM ids GROUP BY doc_id)"""
ORACLE["encode_ids"] = f"WITH {_ENC_SQL} SELECT doc_id, input_ids FROM enc"


def _blocks(spark, sf):
    enc = _encoded(spark, sf)
    idx = global_index(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "idx")
    return K.pack_blocks(enc.join(idx, "doc_id"), "idx", BLOCK_LEN, BATCH_DOCS)


def pack_blocks(spark, sf):
    """K4: documents joined by <eos> inside batches of 1000, cut into 1024-token blocks."""
    return _blocks(spark, sf)


QUERIES["pack_blocks"] = pack_blocks
_PACK_SQL = f"""{_ENC_SQL},
places AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
toks AS (SELECT doc_id, i // {BATCH_DOCS} AS batch, list_concat(input_ids, [{K.EOS}]) AS t
         FROM enc JOIN places USING (doc_id)),
allt AS (SELECT batch, unnest(a) AS tok, unnest(range(0, len(a))) AS off, len(a) AS total
         FROM (SELECT batch, flatten(list(t ORDER BY doc_id)) AS a FROM toks GROUP BY batch)),
blocks AS (SELECT CAST(batch AS BIGINT) AS batch, CAST(off // {BLOCK_LEN} AS BIGINT) AS block,
                  list(tok ORDER BY off) AS input_ids
           FROM allt WHERE off < total - total % {BLOCK_LEN} GROUP BY batch, off // {BLOCK_LEN})"""
ORACLE["pack_blocks"] = f"""
WITH {_PACK_SQL}
SELECT batch, block, input_ids, list_transform(range({BLOCK_LEN}), lambda x: 1) AS attention_mask FROM blocks
"""


def _keyed(blocks):
    """Blocks with their key; their attention masks, all ones, are not sent through the masking."""
    return blocks.drop("attention_mask").withColumn("block_key", F.col("batch") * 1_000_000 + F.col("block"))


def _masked(spark, sf):
    b = _keyed(_blocks(spark, sf))
    return K.mask_tokens(b, "block_key", VOCAB_SIZE, 0.30, MASK_SEED)


def mask_tokens(spark, sf):
    """K5: 30 % of positions chosen by hash; labels -100 elsewhere."""
    return _masked(spark, sf).select("batch", "block", "input_ids", "labels")


QUERIES["mask_tokens"] = mask_tokens


def _u_sql(i, start):
    h = f"sha256('{MASK_SEED}:' || CAST(batch * 1000000 + block AS VARCHAR) || ':' || CAST({i} AS VARCHAR))"
    return f"(('0x' || substr({h}, {start}, 8))::UBIGINT / {float(16 ** 8)})"


_MASK_SQL = f"""{_PACK_SQL},
masked AS (SELECT batch, block,
  list_transform(range(0, len(input_ids)), lambda i: CASE WHEN {_u_sql('i', 1)} < 0.3 AND {_u_sql('i', 9)} < 0.8 THEN {K.MASK}
       WHEN {_u_sql('i', 1)} < 0.3 AND {_u_sql('i', 9)} < 0.9 THEN CAST(floor({_u_sql('i', 17)} * {VOCAB_SIZE}) AS INTEGER)
       ELSE input_ids[i + 1] END) AS input_ids,
  list_transform(range(0, len(input_ids)), lambda i: CASE WHEN {_u_sql('i', 1)} < 0.3 THEN input_ids[i + 1] ELSE -100 END) AS labels
  FROM blocks)"""
ORACLE["mask_tokens"] = f"WITH {_MASK_SQL} SELECT batch, block, input_ids, labels FROM masked"


def masked_accuracy(spark, sf):
    """Accuracy of a previous-token predictor on the masked positions."""
    m = _masked(spark, sf).withColumn("pred", K.previous_token_predictions("input_ids"))
    return P.masked_accuracy(m, "pred", "labels")


QUERIES["masked_accuracy"] = masked_accuracy
ORACLE["masked_accuracy"] = f"""
WITH {_MASK_SQL},
z AS (SELECT unnest(list_concat([{K.BOS}], input_ids[1:len(input_ids) - 1])) AS p, unnest(labels) AS g FROM masked)
SELECT count(*) AS masked, round(coalesce(avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END), 0.0), 6) AS accuracy
FROM z WHERE g <> -100
"""


def pairs_to_ir(spark, sf):
    """(user turn, next assistant turn) pairs -> queries q{i}, corpus
    d{i} and qrels; i counts all pairs in (conv_id, turn) order, blank pairs are
    left out after that; texts are stripped."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                       F.col("text").alias("d"))
    p = u.join(a, ["conv_id", "turn"]).withColumns(
        {k: clean_text(k, sentinels=()) for k in ("q", "d")})
    idx = global_index(p, ["conv_id", "turn"], "i").filter((F.col("q") != "") & (F.col("d") != ""))
    return idx.select(F.concat(F.lit("q"), F.col("i").cast("string")).alias("qid"),
                      F.concat(F.lit("d"), F.col("i").cast("string")).alias("did"),
                      F.sha2("q", 256).alias("query"), F.sha2("d", 256).alias("document"))


QUERIES["pairs_to_ir"] = pairs_to_ir
ORACLE["pairs_to_ir"] = f"""
WITH p AS (SELECT u.conv_id, u.turn, {S.strip("coalesce(u.text, '')")} AS q, {S.strip("coalesce(a.text, '')")} AS d
           FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
           WHERE u.role = 'user' AND a.role = 'assistant'),
i AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM p)
SELECT 'q' || i AS qid, 'd' || i AS did, sha256(q) AS query, sha256(d) AS document FROM i
WHERE q <> '' AND d <> ''
"""


def _piece_counts(spark, sf):
    return K.pretoken_counts(table(spark, sf, "documents").select(clean_text("text").alias("text")), "text")


def bpe_vocab(spark, sf):
    """K2: the vocabulary of 42,000 tokens learned from the pieces of all documents."""
    return B.learn_bpe(_piece_counts(spark, sf), 42_000)


QUERIES["bpe_vocab"] = bpe_vocab  # 40,000 rounds in SQL: rows-only; tests compare with a plain loop
SQL_MERGES = 200


def bpe_merges(spark, sf):
    """K2, first 200 merges of the same learner (as many as SQL can follow)."""
    vocab = B.learn_bpe(_piece_counts(spark, sf), num_merges=SQL_MERGES)
    first = vocab.where("kind = 'merge'")
    least = first.agg(F.min("token_id").alias("least"))
    return first.crossJoin(F.broadcast(least)).select((F.col("token_id") - F.col("least") + 1).alias("rank"), "left",
                                                      "right", "count")


QUERIES["bpe_merges"] = bpe_merges
_BPE_SQL = f"""RECURSIVE {_PC_SQL},
learn AS (
  SELECT 0 AS r, piece, n, string_split(piece, '') AS w, NULL::VARCHAR AS a1, NULL::VARCHAR AS b1, NULL::BIGINT AS c1
  FROM pc WHERE piece <> ''
  UNION ALL
  (WITH pairs AS (SELECT a, b, sum(n)::BIGINT AS c
                  FROM (SELECT n, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM learn WHERE len(w) > 1) GROUP BY a, b),
   best AS (SELECT a, b, c, chr(1) || a || chr(2) || chr(1) || b || chr(2) AS two, chr(1) || a || b || chr(2) AS one
            FROM pairs WHERE c >= 2 ORDER BY c DESC, a, b LIMIT 1),
   done AS (SELECT r, piece, n, a, b, c, replace(chr(1) || array_to_string(w, chr(2) || chr(1)) || chr(2), two, one) AS s
            FROM learn, best WHERE r < {SQL_MERGES})
   SELECT r + 1, piece, n, string_split(s[2:-2], chr(2) || chr(1)), a, b, c FROM done)),
merges AS (SELECT DISTINCT r AS rank, a1 AS "left", b1 AS "right", c1 AS "count" FROM learn WHERE r > 0)"""
ORACLE["bpe_merges"] = f'WITH {_BPE_SQL} SELECT rank, "left", "right", "count" FROM merges'


def bpe_encode(spark, sf):
    """K3: ids of all documents by the first 200 merges, <bos> first, cut at 4096."""
    d = _docs(spark, sf)
    return B.encode(d, "doc_id", "text", B.learn_bpe(_piece_counts(spark, sf), num_merges=SQL_MERGES), MAX_LEN)


QUERIES["bpe_encode"] = bpe_encode
ORACLE["bpe_encode"] = f"""
WITH {_BPE_SQL},
alphabet AS (SELECT c, row_number() OVER (ORDER BY c) - 1 + {K.FIRST_PIECE_ID} AS i
             FROM (SELECT DISTINCT unnest(string_split(piece, '')) AS c FROM pc WHERE piece <> '')),
ids AS (SELECT c AS token, i FROM alphabet
        UNION ALL SELECT "left" || "right", rank - 1 + {K.FIRST_PIECE_ID} + (SELECT count(*) FROM alphabet) FROM merges),
last AS (SELECT piece, w FROM learn WHERE r = (SELECT max(r) FROM learn)),
coded AS (SELECT piece, list(CAST(i AS INTEGER) ORDER BY k) AS ids
          FROM (SELECT piece, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS k FROM last) JOIN ids USING (token)
          GROUP BY piece),
dd AS (SELECT doc_id, {_PIECES_SQL.format(t=S.clean('text'))} AS ps FROM documents WHERE {S.clean('text')} <> ''),
ex AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS pos FROM dd)
SELECT doc_id, list_concat([{K.BOS}], flatten(list(ids ORDER BY pos)))[1:{MAX_LEN}] AS input_ids
FROM ex JOIN coded USING (piece) GROUP BY doc_id
"""


def _bpe_encoded(spark, sf, max_len=MAX_LEN):
    vocab = cut_lineage(bpe_vocab(spark, sf))
    return B.encode(_docs(spark, sf), "doc_id", "text", vocab, max_len), vocab


def bpe_decode(spark, sf):
    """K3 there and back: whole texts encoded by the 42,000 tokens and decoded again."""
    encoded, vocab = _bpe_encoded(spark, sf, None)
    return B.decode(encoded, "doc_id", "input_ids", vocab)


QUERIES["bpe_decode"] = bpe_decode
ORACLE["bpe_decode"] = f"""
SELECT doc_id, replace({S.clean('text')}, '▁', ' ') AS text FROM documents WHERE {S.clean('text')} <> ''
"""


def _bpe_blocks(spark, sf):
    encoded, _ = _bpe_encoded(spark, sf)
    idx = global_index(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "idx")
    return K.pack_blocks(encoded.join(idx, "doc_id"), "idx", BLOCK_LEN, BATCH_DOCS)


def bpe_pack_blocks(spark, sf):
    """K4 on the 42,000 tokens."""
    return _bpe_blocks(spark, sf)


def bpe_mask_tokens(spark, sf):
    """K5 on the 42,000 tokens."""
    b = _keyed(_bpe_blocks(spark, sf))
    return K.mask_tokens(b, "block_key", 42_000, 0.30, MASK_SEED).select("batch", "block", "input_ids", "labels")


def bpe_masked_accuracy(spark, sf):
    """D14 on the 42,000 tokens."""
    m = bpe_mask_tokens(spark, sf).withColumn("pred", K.previous_token_predictions("input_ids"))
    return P.masked_accuracy(m, "pred", "labels")


QUERIES["bpe_pack_blocks"] = bpe_pack_blocks
QUERIES["bpe_mask_tokens"] = bpe_mask_tokens
QUERIES["bpe_masked_accuracy"] = bpe_masked_accuracy
