"""Role tables derived by Spark from the driver tables (FIXTURES.md section 3).

``qa_rows`` stands in for a retrieval dataset (query, document, three
negatives, category, language): every document is a row; its query is its
whole cleaned text, so copies are repeated queries; its negatives are the documents 1, 2 and 3
places after it in SHA-256 order of the id (cyclic). All rows, every scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions.text import clean_text
from weft.operators.ordering import partitions_for
from weft.plans import sqlfrag as S
from weft.session import table

_NEGATIVES = 3
#: hex digits of a hash that place a row in a range
_DIGITS = 7
#: bytes of texts in rows that are given on at once
_ROW_BYTES = 1 << 22


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges (``_range``, ``_own``, ..), in order, each with the documents of the next
    ``_NEGATIVES`` rows; rows that are not of the range itself only serve as next ones."""
    held: pa.Table | None = None

    def made(rows: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
        """The first ``n`` rows, which have enough rows behind them."""
        if not n:
            return
        rows = rows.combine_chunks()
        text = rows.column("document")
        own = rows.slice(0, n).drop_columns(["_range", "_own"])
        for k in range(1, _NEGATIVES + 1):
            own = own.append_column(f"negative{k}", text.slice(k, n))
        own = own.filter(rows.column("_own").slice(0, n))
        size = np.cumsum(pc.binary_length(own.column("document")).to_numpy()) // (_ROW_BYTES // 4)
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(size)) + 1):
            if len(part):
                yield from own.slice(part[0], len(part)).combine_chunks().to_batches()

    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if held is None else pa.concat_tables([held, rows])
        at = rows.column("_range").to_numpy()
        ends = [*(np.flatnonzero(np.diff(at)) + 1), len(at)]
        for lo, hi in zip([0, *ends], ends):
            yield from made(rows.slice(lo, hi - lo), max(0, hi - lo - _NEGATIVES))
        held = rows.slice(max(lo, hi - _NEGATIVES), hi - max(lo, hi - _NEGATIVES))


def _key():
    """Order of the rows; a null id comes first."""
    return F.coalesce(F.sha2(F.col("row_id").cast("string"), 256), F.lit(""))


def _place(ranges: int):
    """Number of the range of a hash."""
    digits = F.conv(F.substring(_key(), 1, _DIGITS), 16, 10).cast("bigint")
    return F.coalesce(F.floor(digits * ranges / 16 ** _DIGITS), F.lit(0)).cast("int")


def _ranges(base):
    """How many ranges hashes are cut into, a row for each that is not empty (``_place``; ``_at``: the
    range it becomes, at least ``_NEGATIVES`` rows large; ``_head``: the key of the last of that one's
    first ``_NEGATIVES`` rows; ``_before``: the range before it), how often first rows are repeated
    there, and the number of ranges made."""
    spark, wanted = base.sparkSession, partitions_for(base)
    w = Window.partitionBy("_place").orderBy("_h")
    first = (base.select(_place(wanted).alias("_place"), _key().alias("_h")).withColumn("_n", F.row_number().over(w))
             .where(F.col("_n") <= _NEGATIVES).select("_place", "_h").sort("_place", "_h").collect())  # some rows a range
    groups: list[list] = []
    for r in first:
        if not groups or groups[-1][-1]["_place"] != r["_place"] and len(groups[-1]) >= _NEGATIVES:
            groups.append([])
        groups[-1].append(r)
    if len(groups) > 1 and len(groups[-1]) < _NEGATIVES:
        last = groups.pop()
        groups[-1] += last
    rows = [(place, i, g[:_NEGATIVES][-1]["_h"], (i or len(groups)) - 1)
            for i, g in enumerate(groups) for place in sorted({r["_place"] for r in g})]
    copies = 1 if len(first) >= _NEGATIVES else _NEGATIVES  # fewer rows come round again
    return wanted, spark.createDataFrame(rows, "_place int, _at int, _head string, _before int"), copies, max(1, len(groups))


def qa_rows(spark, sf):
    """The order is that of the ids' hashes, which spread evenly over ranges of their first digits.
    A row moves once, to its range; the first rows of a range also go to the range before it (the
    last one, for the first range), so every row finds the next ones in its own range."""
    d = table(spark, sf, "documents")
    base = d.select(F.col("doc_id").alias("row_id"), clean_text("text").alias("document"),
                    F.col("source").alias("category"), F.col("lang").alias("language"))
    wanted, ends, copies, ranges = _ranges(base)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    moved = base.withColumn("_place", _place(wanted)).join(F.broadcast(ends), "_place")  # a row per range
    own = F.array(F.struct(F.col("_at"), F.lit(0).alias("_copy")))
    more = F.array(*[F.struct(F.col("_before").alias("_at"), F.lit(i + 1).alias("_copy")) for i in range(copies)])
    moved = (moved.withColumn("_to", F.explode(F.when(_key() <= F.col("_head"), F.concat(own, more)).otherwise(own)))
             .select("row_id", "document", "category", "language", _key().alias("_h"), F.col("_to._at").alias("_range"), "_to._copy"))
    ranged = moved.repartitionById(ranges, F.col("_range")).sortWithinPartitions(
        "_range", "_copy", "_h", "document", "category", "language")
    made = ranged.select("_range", (F.col("_copy") == 0).alias("_own"), "row_id", "document", "category", "language").mapInArrow(
        _with_next, f"{kinds}, " + ", ".join(f"negative{k} string" for k in range(1, _NEGATIVES + 1)))
    return made.withColumn("query", F.col("document")).select(
        "row_id", "query", "document", "negative1", "negative2", "negative3", "category", "language")


QA_ROWS_SQL = f"""
qa_base AS (SELECT doc_id AS row_id, {S.clean('text')} AS document, source AS category,
                   lang AS language FROM documents),
qa_rk AS (SELECT *, document AS query,
                 row_number() OVER (ORDER BY sha256(CAST(row_id AS VARCHAR))) - 1 AS rk,
                 count(*) OVER () AS n FROM qa_base),
qa_rows AS (
  SELECT a.row_id, a.query, a.document, b1.document AS negative1, b2.document AS negative2,
         b3.document AS negative3, a.category, a.language
  FROM qa_rk a JOIN qa_rk b1 ON b1.rk = (a.rk + 1) % a.n
               JOIN qa_rk b2 ON b2.rk = (a.rk + 2) % a.n
               JOIN qa_rk b3 ON b3.rk = (a.rk + 3) % a.n)
"""


def corpus_with_split(spark, sf):
    """Unique cleaned documents with their stable id and hash split."""
    from weft.functions.hashing import hash_split
    from weft.operators.corpus import prepare_corpus_rows
    rows = prepare_corpus_rows(table(spark, sf, "documents"))
    return rows.withColumn("split", hash_split("id"))


CORPUS_SPLIT_SQL = f"""{S.CORPUS_ROWS},
corpus_split AS (SELECT *, {S.hash_split('id')} AS split FROM corpus_rows)
"""
