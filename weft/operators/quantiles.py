"""Exact quantiles per group without a buffer of distinct values.

The k-th value of a group is found by narrowing: its range is cut into ``BINS`` bins, rows
are counted per (group, target, bin) with the least and largest value of each bin, and the
bin that holds the k-th value becomes the new range, until it holds one value. A pass is one
aggregate whose result has at most ``BINS`` rows per target, whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ordering import null_safe_join
from weft.session import cut_lineage

BINS = 1024
#: passes until doubles of any size must have met; a pass leaves a thousandth of the range
MAX_PASSES = 200
#: (group, target) rows sent to every executor at most
MAX_TARGETS = 1 << 18


def exact_quantiles(df: DataFrame, group: Sequence[str], values: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group.., one array column per value): the quantiles ``probs`` of the non-null numbers
    of each value column, interpolated between neighbours as ``percentile`` does; NULL for a
    group without any. Null groups are groups; NaN counts as larger than any number."""
    g = list(group)
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("col"), F.col(v).cast("double").alias("v")) for v in values]))
    rows = df.select(*g, stacked.alias("_x")).select(*g, F.col("_x.col").alias("_col"), F.col("_x.v").alias("_v"))
    rows = cut_lineage(rows.where(F.col("_v").isNotNull()))
    keys = [*g, "_col"]
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = [F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for i, p in enumerate(probs)]
    asked = cut_lineage(size.withColumn("_p", F.explode(F.array(*place))).select(
        *keys, "_lo", "_hi", F.col("_p.i").alias("_i"), F.col("_p.at").alias("_at")))
    ends = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))
    open_ = asked.withColumn("_k", ends).select(*keys, F.col("_k").cast("long").alias("_k"), "_lo", "_hi",
                                                F.lit(0).cast("long").alias("_before")).distinct()
    found = None
    for _ in range(MAX_PASSES):
        open_ = cut_lineage(open_)
        settled = open_.where(F.col("_lo") == F.col("_hi")).select(*keys, "_k", F.col("_lo").alias("_v"))
        found = settled if found is None else found.unionByName(settled)
        open_ = open_.where(F.col("_lo") != F.col("_hi"))
        left = open_.count()
        if not left:
            break
        side = F.broadcast(open_) if left <= MAX_TARGETS else open_
        at = null_safe_join(rows, side, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves first: the difference of two doubles may be too large for one
        width = (F.col("_hi") / 2 - F.col("_lo") / 2) / BINS
        share = F.when(width > 0, F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width)).otherwise(
            F.when(F.col("_v") == F.col("_lo"), 0).otherwise(BINS - 1))
        last = (F.col("_v") == F.col("_hi"))
        bins = F.when(last, F.lit(BINS - 1)).otherwise(F.least(share, F.lit(BINS - 2)))
        counts = at.groupBy(*keys, "_k", "_before", bins.cast("int").alias("_bin")).agg(
            F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_m").over(Window.partitionBy(*keys, "_k").orderBy("_bin"))  # BINS rows at most
        counts = counts.withColumn("_upto", F.col("_before") + upto)
        open_ = counts.where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_m") <= F.col("_k"))).select(
            *keys, "_k", "_lo", "_hi", (F.col("_upto") - F.col("_m")).alias("_before"))
    else:
        raise RuntimeError("quantiles did not settle")
    found = cut_lineage(found)
    low = null_safe_join(asked.withColumn("_k", F.floor("_at").cast("long")), found.withColumnRenamed("_v", "_a"), [*keys, "_k"])
    both = null_safe_join(low.drop("_k").withColumn("_k", F.ceil("_at").cast("long")), found.withColumnRenamed("_v", "_b"),
                          [*keys, "_k"])
    part = F.col("_at") - F.floor("_at")
    # neighbours that are equal need no sum, which could overflow
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b"))
    each = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_col") == v, F.struct("_i", "_q")))), lambda x: x["_q"])
            for v in values]
    out = both.withColumn("_q", value).groupBy(*g).agg(*[e.alias(v) for v, e in zip(values, each, strict=True)])
    return out.select(*g, *[F.when(F.size(v) > 0, F.col(v)).alias(v) for v in values])
