"""Composition and length profiles.

Loops over dimensions in the reference become one scan with GROUPING SETS;
percent-of-total windows run on the already aggregated (small) result.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ordering import null_safe_join
from weft.operators.quantiles import exact_quantiles
from weft.session import cut_lineage


def share_by_group(df: DataFrame, group: Sequence[str], decimals: int = 2) -> DataFrame:
    """Count and percent of total per group."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, decimals))


def value_counts_multi(df: DataFrame, dims: Sequence[str], decimals: int = 2,
                       by: Sequence[str] = ()) -> DataFrame:
    """Value counts of several dimensions in one scan (long form:
    [by..], dimension, value, n, pct of the [by..] group). NULL values are
    dropped, as pandas ``value_counts`` does."""
    view = f"_vc_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    by_sql = "".join(f"{b}, " for b in by)
    sets = ", ".join(f"({by_sql}{d})" for d in dims)
    dim_name = "CASE " + " ".join(
        f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims) + " END"
    dim_val = "CASE " + " ".join(
        f"WHEN grouping({d}) = 0 THEN CAST({d} AS STRING)" for d in dims) + " END"
    sql = f"""
      SELECT {by_sql}{dim_name} AS dimension, {dim_val} AS value, count(*) AS n
      FROM {view} GROUP BY GROUPING SETS ({sets})"""
    out = df.sparkSession.sql(sql).filter(F.col("value").isNotNull())
    part = Window.partitionBy(*by, "dimension")
    return out.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(part), decimals))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Row x class counts; missing cells are 0; rows with a NULL key
    are left out. ``values`` are the
    class labels (listed, so no extra distinct pass)."""
    return df.where(F.col(row).isNotNull()).groupBy(row).pivot(col, list(values)).count().na.fill(0)


def stack_fields(df: DataFrame, fields: Sequence[str], id_col: str | None = None) -> DataFrame:
    """Unpivot text fields to ([id], field, text)."""
    return df.unpivot([id_col] if id_col else [], list(fields), "field", "text")


def length_summary(lengths: DataFrame, decimals: int = 6) -> DataFrame:
    """Per field: min, median, mean, max words; median and mean chars
    (exact medians, interpolated like pandas)."""
    lengths = cut_lineage(lengths.select("field", "words", "chars"))  # several passes read it
    rest = lengths.groupBy("field").agg(
        F.min("words").alias("min_words"), F.round(F.avg("words"), decimals).alias("mean_words"),
        F.max("words").alias("max_words"), F.round(F.avg("chars"), decimals).alias("mean_chars"))
    q = exact_quantiles(lengths, ["field"], ["words", "chars"], [0.5])
    return null_safe_join(rest, q, ["field"], "left").select(
        "field", "min_words", F.round(F.col("words")[0], decimals).alias("median_words"), "mean_words", "max_words",
        F.round(F.col("chars")[0], decimals).alias("median_chars"), "mean_chars")


def box_stats(lengths: DataFrame, value: str = "words", decimals: int = 6) -> DataFrame:
    """Quartiles per field (interpolated, like pandas)."""
    lengths = cut_lineage(lengths.select("field", value))  # several passes read it
    rest = lengths.groupBy("field").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = exact_quantiles(lengths, ["field"], [value], [0.25, 0.5, 0.75]).withColumnRenamed(value, "_q")
    return null_safe_join(rest, q, ["field"], "left").select(
        "field", "lo", *[F.round(F.col("_q")[i], decimals).alias(f"q{i + 1}") for i in range(3)], "hi")


def confounding(df: DataFrame, a: str, b: str) -> DataFrame:
    """Is a -> b a function, and b -> a? (one row of booleans)."""
    pairs = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    ab = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("_k")).agg(F.max("_k").alias("_ab"))
    ba = pairs.groupBy(b).agg(F.count(F.lit(1)).alias("_k")).agg(F.max("_k").alias("_ba"))
    return ab.crossJoin(ba).select(  # two one-row tables
        (F.col("_ab") == 1).alias(f"{a}_determines_{b}"),
        (F.col("_ba") == 1).alias(f"{b}_determines_{a}"),
        ((F.col("_ab") == 1) & (F.col("_ba") == 1)).alias("one_to_one"))


def factor_coverage(df: DataFrame, dims: Sequence[str], decimals: int = 6) -> DataFrame:
    """Observed tuples (NULLs kept, like drop_duplicates) over the product
    of per-dimension cardinalities (NULL-free, like nunique)."""
    observed = df.select(*dims).distinct().agg(F.count(F.lit(1)).alias("observed"))
    cards = df.agg(*[F.countDistinct(d).alias(f"_c{i}") for i, d in enumerate(dims)])
    prod = F.lit(1).cast("bigint")
    for i in range(len(dims)):
        prod = prod * F.col(f"_c{i}")
    return observed.crossJoin(cards).select(  # two one-row tables
        "observed", prod.alias("possible"),
        F.round(F.col("observed") / prod, decimals).alias("coverage"))


def fingerprint(df: DataFrame, id_col: str) -> DataFrame:
    """Order-free, mergeable digest of a set of hex ids.

    Each id contributes two 64-bit words of SHA-256(id); the words are summed
    (decimal, exact) and reduced mod 2^64 with the row count. Same set -> same
    digest at any parallelism; one partial aggregate, no group gathered.
    (Deliberately not byte-equal to the reference's ordered running hash.)
    """
    h = F.sha2(F.col(id_col), 256)
    w1 = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    w2 = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(w1).cast("decimal(38,0)").alias("_s1"),
                 F.sum(w2).cast("decimal(38,0)").alias("_s2"))
    mod = F.lit(str(2 ** 64)).cast("decimal(38,0)")
    parts = F.concat_ws(":", F.col("rows").cast("string"),
                        F.pmod(F.col("_s1"), mod).cast("decimal(20,0)").cast("string"),
                        F.pmod(F.col("_s2"), mod).cast("decimal(20,0)").cast("string"))
    return agg.select("rows", F.sha2(parts, 256).alias("fingerprint"))


def split_coverage(df: DataFrame, split_col: str, dims: Sequence[str]) -> DataFrame:
    """Rows and distinct values of each dimension per split."""
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.countDistinct(d).alias(f"distinct_{d}") for d in dims])


def composition_overview(counts: DataFrame) -> DataFrame:
    """Per dimension: number of values, min and max rows per value."""
    return counts.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("values"), F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"))


def masked_accuracy(df: DataFrame, pred_col: str, gold_col: str, ignore: int = -100,
                    decimals: int = 6) -> DataFrame:
    """Share of positions where predicted == gold among gold != ignore,
    and their count; 0 when none."""
    z = df.select(F.explode(F.arrays_zip(F.col(pred_col).alias("p"), F.col(gold_col).alias("g")))
                  .alias("_z")).filter(F.col("_z.g") != ignore)
    return z.agg(F.count(F.lit(1)).alias("masked"),
                 F.round(F.coalesce(F.avg((F.col("_z.p") == F.col("_z.g")).cast("double")),
                                    F.lit(0.0)), decimals).alias("accuracy"))


def perplexity(loss: Column, cap: float = 20.0) -> Column:
    """exp(min(mean loss, cap)) (an aggregate expression)."""
    return F.exp(F.least(F.avg(loss), F.lit(cap)))
