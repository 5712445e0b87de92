"""JSON request items and response validation (B22, B23), all built-in.

Bad responses stay data: every row gets a ``status`` ('ok' or 'error') and a
``reason`` instead of raising, so one malformed reply never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import _c, py_strip

#: a whole reply that opens a fence; the closing fence may be absent
FENCE = r"(?s)\A`{3}(?:json\b)?(.*?)(?:`{3})?\z"
RESPONSE_SCHEMA = "struct<translations: array<struct<id: string, translation: string>>>"


def request_items(df: DataFrame, batch_cols, id_col: str, text_col: str) -> DataFrame:
    """One JSON array of {id, text} per batch, ordered by id."""
    items = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"),
                                                 F.col(text_col).alias("text"))))
    return df.groupBy(*batch_cols).agg(F.to_json(items).alias("items"))


def strip_fence(content: str | Column) -> Column:
    """Remove a surrounding Markdown code fence (optionally tagged json)."""
    s = py_strip(content)
    inner = F.regexp_extract(s, FENCE, 1)
    return F.when(s.rlike(FENCE), py_strip(inner)).otherwise(s)


def parse_response(content: str | Column, expected_ids: str | Column) -> Column:
    """struct(status, reason, translations) for one response; the reason is a
    code: shape, count, ids or blank.

    Checks, in order: an object with a ``translations`` array; the same
    length as the expected ids; ids equal position by position; every
    translation a non-blank string. Translations are stripped.
    """
    parsed = F.from_json(strip_fence(content), RESPONSE_SCHEMA)
    tr = parsed["translations"]
    exp = _c(expected_ids)
    id_bad = F.exists(F.zip_with(tr, exp, lambda t, e: F.coalesce(t["id"], F.lit("")) != e),
                      lambda x: x)
    blank = F.exists(tr, lambda t: t["translation"].isNull() | (py_strip(t["translation"]) == ""))
    reason = (F.when(tr.isNull(), "shape")
              .when(F.size(tr) != F.size(exp), "count")
              .when(id_bad, "ids")
              .when(blank, "blank")
              .otherwise(F.lit(None)))
    clean = F.transform(tr, lambda t: F.struct(t["id"].alias("id"),
                                               py_strip(t["translation"]).alias("translation")))
    return F.struct(F.when(reason.isNull(), "ok").otherwise("error").alias("status"),
                    reason.alias("reason"),
                    F.when(reason.isNull(), clean).alias("translations"))
