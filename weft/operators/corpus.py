"""Corpus build: clean, id, dedup, quota-mix, split (C1, F1-F4, entry slice).

Order-dependent steps ("first rows of a source") take an explicit total order
(trap T8). None of them uses an unpartitioned window on row-level data, and
per-group limits run in two salted stages so that one source holding a third
of all rows never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.hashing import hash_split, stable_row_id
from weft.functions.text import clean_text
from weft.operators.ordering import null_safe_join, positions_in_group
from weft.session import cut_lineage

# Salt buckets for per-group limits: a hot group is spread over this many
# tasks in the first stage, then at most n rows per bucket meet in stage two.
SALT_BUCKETS = 64
# A group known to hold at most this many rows is ranked in one task.
SINGLE_STAGE_MAX_ROWS = 1_000_000


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def dedup_first(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every key.

    ``min_by`` over a struct is a partial aggregate: each map task combines
    its own rows first, so a hot key ships one row per task, not all of them.
    """
    keys = _cols(key)
    order_cols = _cols(order)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    ordkey = F.struct(*[F.col(c) for c in order_cols])
    out = df.groupBy(*keys).agg(F.min_by(packed, ordkey).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def first_n_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column | str],
                      n: int | Column, max_n: int | None = None,
                      rank_col: str | None = None, salt_buckets: int = SALT_BUCKETS,
                      max_group_rows: int | None = None) -> DataFrame:
    """Rows whose rank by ``order`` inside their group is <= n.

    ``n`` may be a literal or a column (per-group quota); ``max_n`` is a
    literal upper bound used by the first stage. Stage 1 ranks inside
    (group, salt) and keeps ``max_n`` rows, which Spark turns into a map-side
    group limit; stage 2 ranks the survivors (at most max_n * salt_buckets
    per group). The result is exact: a row among the first n of its group is
    among the first n of its salt bucket. When the caller knows every group
    holds at most ``max_group_rows`` <= SINGLE_STAGE_MAX_ROWS rows, one
    window suffices and the salted stage is skipped.
    """
    groups = _cols(group)
    order_exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    name = rank_col or "_rn"
    lim = F.lit(n) if isinstance(n, int) else n
    if max_group_rows is not None and max_group_rows <= SINGLE_STAGE_MAX_ROWS:
        w = Window.partitionBy(*groups).orderBy(*order_exprs)
        out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= lim)
        return out if rank_col else out.drop(name)
    bound = n if isinstance(n, int) else max_n
    if bound is None:
        raise ValueError("max_n is required when n is a column")
    salt = F.pmod(F.xxhash64(*order_exprs), F.lit(salt_buckets))
    w1 = Window.partitionBy(*groups, salt).orderBy(*order_exprs)
    stage1 = (df.withColumn("_rn1", F.row_number().over(w1))
                .filter(F.col("_rn1") <= F.lit(bound)).drop("_rn1"))
    w2 = Window.partitionBy(*groups).orderBy(*order_exprs)
    out = stage1.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= lim)
    return out if rank_col else out.drop(name)


def quota_largest_remainder(weights: DataFrame, total: int | Column, weight_col: str,
                            index_col: str, out_col: str = "quota") -> DataFrame:
    """integer shares of ``total`` by weights (largest remainder).

    Exact integer arithmetic: base = floor(total*w/W); the leftover units go
    to the largest remainders, ties to the lower index. ``weights`` is a small
    table (one row per source), so the global window runs on it alone.
    """
    wsum = F.sum(weight_col).over(Window.partitionBy())
    tot = F.lit(total) if isinstance(total, int) else total
    step = (weights
            .withColumn("_W", wsum)
            .withColumn("_T", tot.cast("bigint"))
            .withColumn("_num", F.col("_T") * F.col(weight_col).cast("bigint"))
            .withColumn("_base", F.expr("_num div _W"))
            .withColumn("_rem", F.expr("_num % _W")))
    step = step.withColumn("_left", F.col("_T") - F.sum("_base").over(Window.partitionBy()))
    step = step.withColumn(
        "_rk", F.row_number().over(Window.partitionBy().orderBy(F.desc("_rem"), F.col(index_col))))
    return (step.withColumn(out_col, (F.col("_base") + F.when(F.col("_rk") <= F.col("_left"), 1)
                                      .otherwise(0)).cast("bigint"))
                .drop("_W", "_T", "_num", "_base", "_rem", "_left", "_rk"))


def corpus_quotas(sources: DataFrame, total: int | DataFrame, index_col: str = "source",
                  shares: Sequence[int] = (60, 20, 20), fixed: int = 2) -> DataFrame:
    """the first ``fixed`` sources get 60 % and 20 %; the remaining sources
    share the last 20 % evenly (each allocation by F1).

    ``total`` is an int or a one-row frame with column ``t``.
    """
    tiers = sources.sparkSession.createDataFrame(
        [(i, w) for i, w in enumerate(shares)], "tier int, weight bigint")
    if isinstance(total, DataFrame):
        tiers = tiers.crossJoin(F.broadcast(total.select("t")))  # one-row table
        total = F.col("t")
    tier_q = quota_largest_remainder(tiers, total, "weight", "tier", "tier_quota")
    w = Window.partitionBy().orderBy(index_col)
    ranked = sources.select(index_col).distinct().withColumn("_i", F.row_number().over(w) - 1)
    ranked = ranked.withColumn("tier", F.least(F.col("_i"), F.lit(fixed)).cast("int"))
    fixed_part = (ranked.filter(F.col("tier") < fixed).join(tier_q, "tier")
                  .select(index_col, F.col("tier_quota").alias("quota")))
    shared = ranked.filter(F.col("tier") == fixed).withColumn("_one", F.lit(1).cast("bigint"))
    shared_total = tier_q.filter(F.col("tier") == fixed).select("tier_quota")
    shared = shared.crossJoin(F.broadcast(shared_total))  # one-row table
    shared_q = quota_largest_remainder(shared, F.col("tier_quota"), "_one", "_i")
    return fixed_part.unionByName(shared_q.select(index_col, "quota"))


def take_quota(rows: DataFrame, quotas: DataFrame, group: str, order: Sequence[str],
               quota_col: str = "quota", shortfall: str = "error") -> DataFrame:
    """the first ``quota`` rows of every group by ``order`` (a total order inside
    the group); exact for groups and quotas of any size.

    Only (group, order) is indexed. The row at each group's last position gives
    one threshold per group, and every row compares itself with its group's
    threshold; no group meets in a task. A group without a quota gives no rows,
    a null group is a group like others. A group with fewer rows than its quota
    raises, or gives all its rows with ``shortfall="allow"``.
    """
    keys = rows.select(group, *order)
    pos = positions_in_group(keys, [group], order, "_pos")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    plan = null_safe_join(quotas.select(group, quota_col), sizes, [group], "left")
    plan = plan.withColumn("_n", F.coalesce("_n", F.lit(0)))
    last = null_safe_join(pos, quotas.select(group, quota_col), [group]).filter(
        F.col("_pos") == F.col(quota_col) - 1).select(group, F.struct(*order).alias("_cut"))
    plan = cut_lineage(null_safe_join(plan, last, [group], "left"))  # one row per group
    if shortfall == "error":
        check_shortfall(plan.filter(F.col("_n") < F.col(quota_col)), group, quota_col)
    joined = null_safe_join(rows, plan, [group])
    keep = (F.col(quota_col) > 0) & (F.col("_cut").isNull() | (F.struct(*order) <= F.col("_cut")))
    return joined.filter(keep).drop(quota_col, "_n", "_cut").select(*rows.columns)


def check_shortfall(short: DataFrame, group: str, quota_col: str) -> None:
    """Raise if ``short`` (group, quota, rows there are) has a row; names a few of them."""
    some = short.select(group, quota_col, "_n").orderBy(group).limit(5).collect()
    if some:
        raise ValueError("fewer rows than the quota: " + ", ".join(f"{r[0]!r} has {r[2]} of {r[1]}" for r in some))


def round_robin_quotas(sizes: DataFrame, group: str, total: int, index: str | None = None) -> DataFrame:
    """how many rows each group gives when ``total`` rows are taken one per group
    and round, in ``index`` order; groups without rows left drop out.

    ``sizes`` (group, n) is one row per group. With the sizes in ascending order,
    the rows taken when group i runs out are sum(n_1..n_i) + (G - i) * n_i; the
    last such point that ``total`` reaches gives the number of full rounds. Fewer
    than ``total`` rows in all raise.
    """
    idx = index or group
    up = Window.orderBy("n", idx)
    whole = Window.partitionBy()
    s = sizes.withColumn("_i", F.row_number().over(up)).withColumn("_G", F.count(F.lit(1)).over(whole)).withColumn(
        "_all", F.sum("n").over(whole))
    s = s.withColumn("_at", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0))
                     + (F.col("_G") - F.col("_i")) * F.col("n"))
    reached = F.when(F.col("_at") <= total, F.struct("_at", "_i", F.col("n").alias("_r")))
    s = s.withColumn("_last", F.coalesce(F.max(reached).over(whole), F.struct(
        F.lit(0).cast("bigint").alias("_at"), F.lit(0).alias("_i"), F.lit(0).cast("bigint").alias("_r"))))
    open_ = F.col("_G") - F.col("_last._i")
    left = F.lit(total) - F.col("_last._at")
    full = F.col("_last._r") + F.when(open_ > 0, F.floor(left / open_)).otherwise(0)
    s = s.withColumn("_full", full.cast("bigint")).withColumn(
        "_more", F.when(open_ > 0, F.pmod(left, open_)).otherwise(0))
    more = F.row_number().over(Window.partitionBy(F.col("n") > F.col("_full")).orderBy(idx)) <= F.col("_more")
    quota = F.least("n", "_full") + F.when((F.col("n") > F.col("_full")) & more, 1).otherwise(0)
    few = F.raise_error(F.concat(F.lit(f"{total} rows asked for, there are "), F.col("_all").cast("string")))
    return s.select(group, F.when(F.col("_all") < total, few.cast("bigint")).otherwise(quota).cast("bigint").alias("quota"))


def round_robin_quota(rows: DataFrame, group: str, order: Sequence[str], total: int,
                      group_index: str | None = None) -> DataFrame:
    """a shared quota taken one row per group per round (``round``, from 1), in
    group order; exhausted groups drop out and the rest continue. Fewer than
    ``total`` rows raise.

    ``round_robin_quotas`` turns the rounds into one quota per group; each row's
    round is its position inside its group.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                    *([F.min(group_index).alias(group_index)] if group_index else []))
    quotas = cut_lineage(round_robin_quotas(sizes, group, total, group_index))
    # only (group, order) is indexed; of the rows those that are taken move, once
    keys = positions_in_group(rows.select(group, *order), [group], list(order), "_pos")
    taken = null_safe_join(keys, quotas, [group]).filter(F.col("_pos") < F.col("quota")).select(
        group, *order, (F.col("_pos") + 1).alias("round"))
    return null_safe_join(rows, taken, [group, *order])


def prepare_corpus_rows(docs: DataFrame, text_col: str = "text", source_col: str = "source",
                        order_col: str = "doc_id") -> DataFrame:
    """B1 + drop empty + B4 + C1: unique non-empty cleaned rows with ids."""
    cleaned = (docs.select(order_col, source_col, clean_text(text_col).alias("text"),
                           *[c for c in ("lang",) if c in docs.columns])
               .filter(F.col("text") != ""))
    # a null source is hashed as an empty one, so its rows keep distinct ids
    with_id = cleaned.withColumn("id", stable_row_id(F.coalesce(F.col(source_col), F.lit("")), F.col("text")))
    return dedup_first(with_id, "id", order_col)


def build_corpus(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """Entry slice: documents -> clean -> id -> dedup -> quota per source
    (largest remainder of share*rows by source size) -> hash split."""
    # read twice (sizes, then the take): written once instead of de-duplicating twice
    rows = cut_lineage(prepare_corpus_rows(docs))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(share))
    quotas = quota_largest_remainder(sizes, total, "n", "source")
    picked = take_quota(rows, quotas, "source", ["doc_id"])
    return picked.withColumn("split", hash_split("id"))


def counts_by_source_split(corpus: DataFrame) -> DataFrame:
    """Rows per (source, split)."""
    return corpus.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
