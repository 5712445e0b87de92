"""Benchmark decontamination: which documents contain a benchmark item.

An item counts as contained if at least ``threshold`` of its word shingles occur
in the document. Search and verification use DataFrame functions only.

Search. Items are put in partitions by size (number of distinct shingles, powers
of two). An item's MinHash sketch is its k shingles with the smallest hashes,
where k follows from its partition's upper size u: k = u - ceil(threshold * u) + 1.
A document that contains the item lacks fewer than k of its shingles, so it holds
at least one shingle of the sketch: the search loses nothing, at any size of
document. A document is a candidate if it has enough shingles for the item and
holds a shingle of its sketch. The sketches are broadcast when they are few
(``broadcast_rows``), and joined by hash otherwise.

Verification. The shingles of the candidate documents are compared, as text, with
those of their items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import kept, text_hash, without

WORD = r"[\p{L}\p{N}]+"
#: sketch rows (one hash and a few numbers each, some 60 bytes) sent to every executor at most
BROADCAST_ROWS = 1 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(w: str, n: int, make) -> Column:
    """``make`` of every run of n words (as a list of columns), in order."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: make([F.get(F.col(w), i + k) for k in range(n)])))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def shingle_hashes(w: str, n: int) -> Column:
    return F.coalesce(_windows(w, n, lambda x: F.xxhash64(*x)), _none("bigint"))


def shingle_texts(w: str, n: int) -> Column:
    return F.coalesce(_windows(w, n, lambda x: F.concat_ws(" ", *x)), _none("string"))


def item_key(text_col: str) -> Column:
    """What names an item here: its text. Ids may be null or stand for several texts."""
    return F.sha2(F.col(text_col).cast("binary"), 256)


def item_shingles(items: DataFrame, text_col: str, n: int) -> DataFrame:
    """(item, len, shingle, hash): distinct shingles of the items; an item of fewer than
    n words is one shingle of all its words (len of them)."""
    w = items.select(item_key(text_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    sizes = range(1, n + 1)
    texts, hashes = shingle_texts("w", n), shingle_hashes("w", n)
    for k in sizes[:-1]:
        texts = F.when(F.size("w") == k, shingle_texts("w", k)).otherwise(texts)
        hashes = F.when(F.size("w") == k, shingle_hashes("w", k)).otherwise(hashes)
    both = F.explode(F.arrays_zip(texts.alias("shingle"), hashes.alias("hash")))
    return w.select("item", length.alias("len"), both.alias("s")).select(
        "item", "len", F.col("s.shingle").alias("shingle"), F.col("s.hash").alias("hash")).distinct()


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item, len, hash, needs): the sketch of every item, and the least number
    of shingles that contain it."""
    size = shingles.groupBy("item").agg(F.count("*").alias("n"))
    size = size.withColumn("upper", (F.pow(F.lit(2.0), F.floor(F.log2(F.col("n"))) + 1) - 1).cast("long"))
    size = size.withColumn("k", F.col("upper") - F.ceil(F.col("upper") * threshold - 1e-9) + 1)
    w = Window.partitionBy("item").orderBy("hash", "shingle")
    ranked = shingles.withColumn("r", F.row_number().over(w)).join(size, "item").where("r <= k")
    return ranked.select("item", "len", "hash", F.ceil(F.col("n") * threshold - 1e-9).alias("needs"))


def containment(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id",
                text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, text_hash, item_id, n_shingles, n_found, containment) of every document
    and item with containment >= ``threshold``.

    Words are lower-cased runs of letters and digits; shingles are ``n`` words.
    An item without words is contained nowhere; a null or empty text contains
    nothing. An item is its text: texts under one id are items of their own, with a
    row each; equal rows are one item; a null ``item_id`` is kept as null. Documents with the same id and different texts are told
    apart by ``text_hash``; repeated rows give one row. A null id is kept as null.
    Other columns are ignored. Empty tables give no rows.
    """
    shingles = kept(item_shingles(items, item_text, n), "items")
    sketch = kept(sketches(shingles, threshold), "sketches")
    lengths = sorted(r[0] for r in sketch.select("len").distinct().collect())  # at most n numbers
    base = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))
    with_words = base.withColumn("w", words(F.col("text")))
    if not lengths:
        lengths = [n]
    hashed = F.flatten(F.array(*[F.array_distinct(shingle_hashes("w", k)) for k in lengths])) if len(lengths) > 1 \
        else F.array_distinct(shingle_hashes("w", lengths[0]))
    probes = with_words.select("id", "text_hash", F.size("w").alias("n_words"), F.explode(hashed).alias("hash"))
    few = sketch.count() <= broadcast_rows
    hits = probes.join(F.broadcast(sketch) if few else sketch, "hash").where(
        F.col("n_words") - F.col("len") + 1 >= F.col("needs"))
    per_doc = hits.groupBy("id", "text_hash").agg(F.collect_set("item").alias("items"))
    per_doc = kept(per_doc, "candidates")

    # verification: the documents' shingles as text, once per candidate document
    candidate = base.join(per_doc.withColumnRenamed("id", "cid").withColumnRenamed("text_hash", "ch"),
                          (F.col("text_hash") == F.col("ch")) & F.col("id").eqNullSafe(F.col("cid")))
    candidate = candidate.dropDuplicates(["id", "text_hash"]).withColumn("w", words(F.col("text")))
    texts = [shingle_texts("w", k) for k in lengths]
    has = candidate.select("id", "text_hash", "items", F.array_distinct(F.concat(*texts)).alias("has"))
    pairs = has.select("id", "text_hash", F.explode("items").alias("item"), "has")
    by_item = shingles.groupBy("item").agg(F.collect_set("shingle").alias("wants"))
    checked = pairs.join(F.broadcast(by_item) if few else by_item, "item").select(
        "id", "text_hash", "item", F.size("wants").alias("n_shingles"),
        F.size(F.array_intersect("has", "wants")).alias("n_found"))
    checked = checked.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    found = checked.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
    names = items.select(item_key(item_text).alias("item"), F.col(item_col).alias("item_id")).distinct()
    return found.join(F.broadcast(names) if few else names, "item").select(
        F.col("id").alias(id_col), "text_hash", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"),
        F.col("n_found").cast("long").alias("n_found"), "containment")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """Rows of ``docs``, all columns kept, that contain no item."""
    found = containment(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = found.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"))
    return without(docs, bad, id_col, text_col)


ORACLE_SQL = r"""
WITH iw AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
            FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ish AS (SELECT DISTINCT item, item_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT item, item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item, count(*) AS n FROM ish GROUP BY item),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
f AS (SELECT doc_id, item, item_id, count(*) AS f FROM dsh JOIN ish USING (s) GROUP BY doc_id, item, item_id)
SELECT doc_id, item_id, n AS n_shingles, f AS n_found, f / n AS containment
FROM f JOIN n USING (item) WHERE f >= ceil(n * 0.8 - 1e-9)
"""
