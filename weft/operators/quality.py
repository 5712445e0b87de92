"""Keys, duplicates and integrity checks.

Every check is an aggregation that returns a small table (a count, or the
violating keys); nothing is collected to the driver. Groups are formed with
hash aggregates (partial, map-side), never by gathering a group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import py_strip

from weft.functions.text import _c

# Ids closer than this share a gap-search bucket; a bucket holds at most this
# many distinct ids, so the per-bucket window is bounded whatever the skew.
GAP_BUCKET = 1 << 20


def dup_summary(df: DataFrame, key: str | Column, prefix: str = "") -> DataFrame:
    """Total rows, distinct keys, duplicate rows and duplicate groups."""
    k = _c(key).alias("_k")
    per_key = df.select(k).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").cast("bigint").alias(f"{prefix}rows"),
        F.count(F.lit(1)).alias(f"{prefix}distinct"),
        (F.sum("_n") - F.count(F.lit(1))).cast("bigint").alias(f"{prefix}duplicate_rows"),
        F.count_if(F.col("_n") > 1).cast("bigint").alias(f"{prefix}duplicate_groups"))


def duplicated_keys(df: DataFrame, key: str | Column) -> DataFrame:
    """Keys occurring more than once (partial aggregate)."""
    return (df.select(_c(key).alias("key")).groupBy("key")
            .agg(F.count(F.lit(1)).alias("occurrences"))
            .filter(F.col("occurrences") > 1))


def dup_details(df: DataFrame, key: str | Column, category_col: str,
                positive_col: str) -> DataFrame:
    """Per duplicated key: occurrences, sorted distinct categories and the
    number of distinct positives.

    The reference also lists the row ids of a key; a hot key may hold a
    third of all rows, so that list is given in long form by ``dup_members``
    instead of being gathered into one cell.
    """
    keyed = df.withColumn("key", _c(key))
    rows = keyed.join(duplicated_keys(df, key).select("key"), "key", "left_semi")
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sort_array(F.collect_set(category_col)).alias("categories"),
        F.countDistinct(positive_col).alias("distinct_positives"))


def dup_members(df: DataFrame, key: str | Column, id_col: str) -> DataFrame:
    """C3 (long form): (key, row id) for every row of a duplicated key."""
    keyed = df.select(_c(key).alias("key"), F.col(id_col))
    return keyed.join(duplicated_keys(df, key).select("key"), "key", "left_semi")


def null_empty_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4: per column, NULL count and count of strings that are blank once stripped, in one pass."""
    aggs = []
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if dict(df.dtypes)[c] == "string":
            aggs.append(F.count_if(py_strip(c) == "").alias(f"{c}__empty"))
        else:
            aggs.append(F.lit(0).cast("bigint").alias(f"{c}__empty"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}__nulls`, `{c}__empty`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, nulls, empty)")


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids occurring more than once."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def id_gaps(df: DataFrame, id_col: str, bucket: int = GAP_BUCKET) -> DataFrame:
    """Missing integer ids between min and max, as ranges [start, stop].

    Distinct ids are grouped into buckets of ``bucket`` numbers, where ``lead`` finds the
    gaps; what is left of a bucket is its least and largest id, and these are grouped into
    buckets of ``bucket`` buckets, and so on. A group holds at most ``bucket`` rows at every
    level, however sparse the ids, and a handful are left at the top.
    """
    spans = df.select(F.col(id_col).cast("bigint").alias("_lo")).where("_lo IS NOT NULL").distinct().withColumn("_hi", F.col("_lo"))
    found, width = None, 1
    while True:
        top = width > (1 << 62) // bucket
        width = width if top else width * bucket
        at = F.lit(0) if top else F.call_function("div", F.col("_lo") - F.pmod("_lo", F.lit(width)), F.lit(width))
        keyed = spans.withColumn("_b", at)
        inner = (keyed.withColumn("_next", F.lead("_lo").over(Window.partitionBy("_b").orderBy("_lo")))
                 .filter(F.col("_next") > F.col("_hi") + 1)
                 .select((F.col("_hi") + 1).alias("start"), (F.col("_next") - 1).alias("stop")))
        found = inner if found is None else found.unionByName(inner)
        if top:
            break
        spans = keyed.groupBy("_b").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_b")
    return found.withColumn("missing", (F.col("stop") - F.col("start") + 1).cast("bigint"))


def label_collision(df: DataFrame, positive_col: str, negative_cols: Sequence[str]) -> Column:
    """The positive also appears among its negatives."""
    return F.coalesce(F.array_contains(F.array(*[F.col(c) for c in negative_cols]),
                                       F.col(positive_col)), F.lit(False))


def candidate_texts(df: DataFrame, order_col: str, cols: Sequence[str]) -> DataFrame:
    """Unpivot candidate columns to (text, first-seen order) rows (C7 input)."""
    stacked = df.select(order_col, F.posexplode(F.array(*[F.col(c) for c in cols]))
                        .alias("_pos", "text"))
    return stacked.select("text", F.struct(F.col(order_col), F.col("_pos")).alias("_ord"))


def split_leakage(df: DataFrame, key: str | Column, split_col: str = "split") -> DataFrame:
    """Keys present in more than one split (must be empty)."""
    return (df.select(_c(key).alias("key"), F.col(split_col)).distinct()
            .groupBy("key").agg(F.count(F.lit(1)).alias("splits"),
                                F.sort_array(F.collect_list(split_col)).alias("split_names"))
            .filter(F.col("splits") > 1))


#: the checks of ``integrity_checks``, in order
INTEGRITY_CHECKS = ("parse_errors", "missing_columns", "null_values", "empty_strings", "duplicate_row_ids",
                    "missing_row_ids", "duplicate_query_rows", "duplicate_query_groups", "normalized_duplicate_query_rows",
                    "collision_rows", "unique_candidates")


def integrity_checks(rows: DataFrame, bad_lines: DataFrame, required: Sequence[str], id_col: str, query_col: str,
                     positive_col: str, negative_cols: Sequence[str], normalized: Column) -> DataFrame:
    """(check, count) of a retrieval table as it was read: lines that did not parse,
    required columns that are missing, null values, blank texts, repeated ids and ids missing
    inside their range, rows and groups of repeated queries (as written, and by ``normalized``),
    rows whose positive is among the negatives, and distinct candidate texts.

    Distinct counts of texts are of their hashes; each is one aggregate. A column that is
    missing counts once, and checks that need it give 0."""
    missing = [c for c in required if c not in rows.columns]
    df = rows.select(*rows.columns, *[F.lit(None).cast("string").alias(c) for c in missing])
    texts = [c for c in required if c not in missing and df.schema[c].dataType.simpleString() == "string"]
    there = [c for c in required if c not in missing]
    nulls = [F.count_if(F.col(c).isNull()) for c in there]
    blanks = [F.count_if(py_strip(c) == "") for c in texts]

    def total(parts: list[Column]) -> Column:
        out = F.lit(0).cast("bigint")
        for p in parts:
            out = out + p
        return out

    has = {query_col: query_col not in missing, id_col: id_col not in missing}
    collide = label_collision(df, positive_col, negative_cols) if positive_col not in missing else F.lit(False)
    one = df.agg(total(nulls).alias("null_values"), total(blanks).alias("empty_strings"),
                 F.count_if(collide).alias("collision_rows"), F.count(F.lit(1)).alias("_rows"))
    ids = df.select(F.col(id_col).alias("_k")).where("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_ids"),
        F.coalesce(F.max("_k").cast("bigint") - F.min("_k").cast("bigint") + 1 - F.count(F.lit(1)), F.lit(0)).alias("missing_row_ids"))

    def repeats(key: Column, name: str) -> DataFrame:
        groups = df.select(key.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(f"{name}_rows"),
                          F.count_if(F.col("_n") > 1).alias(f"{name}_groups"))

    exact = repeats(F.sha2(query_col, 256) if has[query_col] else F.lit(None), "duplicate_query")
    folded = repeats(normalized if has[query_col] else F.lit(None), "normalized_duplicate_query")
    candidates = df.select(F.explode(F.array(positive_col, *negative_cols)).alias("_t")).where("_t IS NOT NULL").select(
        F.sha2("_t", 256).alias("_t")).distinct().agg(F.count(F.lit(1)).alias("unique_candidates"))
    bad = bad_lines.agg(F.count(F.lit(1)).alias("parse_errors"))
    # one-row tables
    row = one.crossJoin(ids).crossJoin(exact).crossJoin(folded).crossJoin(candidates).crossJoin(bad).withColumn(
        "missing_columns", F.lit(len(missing)))
    if not has[query_col]:
        row = row.withColumns({c: F.lit(0) for c in INTEGRITY_CHECKS if "query" in c})
    return stack_checks(row, INTEGRITY_CHECKS)


def stack_checks(one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """A one-row frame of check counts -> long (check, count)."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS BIGINT)" for n in names)
    return one_row.selectExpr(f"stack({len(names)}, {pairs}) AS (check, count)")
