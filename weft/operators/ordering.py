"""Order, positions, shuffles, splits, mixtures and budgets.

"First", "next" and "position" need a total order (trap T8). Positions are
computed without a global window: the frame is range-partitioned on the
order, each partition numbers its rows locally, and a small per-partition
offset table (one row per partition) is broadcast back. The range-partitioned
frame is checkpointed first so both passes see the same partition bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.hashing import seeded_order_key
from weft.session import cut_lineage

# Above this many rows an ordered "first n" switches from a top-k take to
# positions + filter, so no single task gathers n rows.
TOPK_LIMIT = 10_000


#: bytes of a range
RANGE_BYTES = 256 << 20


def _ord(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def partitions_for(df: DataFrame) -> int:
    """Ranges to cut ``df`` into: ``spark.sql.shuffle.partitions``, and more where the size of
    its inputs asks for it, so the ranges grow as the data do.

    Catalyst multiplies the estimates of both sides of a join, so its figure for the whole
    plan is only an upper bound beside the sum over the plan's inputs: the bytes of tables,
    and for checkpointed frames, whose estimate may be such a product, the most ranges that
    one of them has.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read, widest = 0, 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.nodeName().startswith("LogicalRDD"):
            widest = max(widest, leaf.rdd().getNumPartitions())
        else:
            read += int(str(leaf.stats().sizeInBytes()))
    size = min(int(str(plan.stats().sizeInBytes())), read + widest * RANGE_BYTES)
    return max(least, size // RANGE_BYTES)


def running_total(df: DataFrame, order: Sequence[str | Column], value: str | Column,
                  out_col: str, num_partitions: int | None = None,
                  materialize: bool = True) -> DataFrame:
    """Inclusive prefix sum of ``value`` in ``order`` (a total order).

    Two levels: a window per range partition, plus the exclusive prefix of
    partition totals (a table with one row per partition).
    """
    n = num_partitions or partitions_for(df)
    oc = _ord(order)
    val = F.col(value) if isinstance(value, str) else value
    ranged = (df.withColumn("_v", val.cast("bigint"))
              .repartitionByRange(n, *oc)
              .withColumn("_pid", F.spark_partition_id()))
    if materialize:
        ranged = cut_lineage(ranged)
    local = ranged.withColumn(
        "_cum", F.sum("_v").over(Window.partitionBy("_pid").orderBy(*oc)
                                 .rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("_pid").agg(F.sum("_v").alias("_t"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(out_col, (F.col("_cum") + F.col("_off")).cast("bigint"))
            .drop("_pid", "_v", "_cum", "_off"))


def global_index(df: DataFrame, order: Sequence[str | Column], index_col: str = "idx",
                 num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """0-based position of every row in ``order`` (a total order).

    Rows are range-partitioned and sorted inside each partition; a row's
    position inside its partition is the low 33 bits of
    ``monotonically_increasing_id`` (fixed by the checkpoint), so no window
    and no second shuffle of the rows is needed; only the one-row-per-
    partition counts are aggregated and broadcast back as offsets.
    """
    n = num_partitions or partitions_for(df)
    oc = _ord(order)
    ranged = (df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    if materialize:
        ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    return (ranged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(index_col, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal key columns, null keys included; the key columns come from ``left``."""
    side = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(side[f"_k_{c}"])
    return left.join(side, cond, how).drop(*[f"_k_{c}" for c in on])


def positions_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], out_col: str) -> DataFrame:
    """0-based position of every row inside its group by ``order`` (a total order).

    One global index over (group, order) minus the group's first position, so no
    task holds a whole group; a null group is a group of its own.
    """
    idx = global_index(df, [*group, *order], "_gi")
    first = idx.groupBy(*group).agg(F.min("_gi").alias("_g0"))
    return null_safe_join(idx, first, group).withColumn(out_col, F.col("_gi") - F.col("_g0")).drop("_gi", "_g0")


def shards(df: DataFrame, index_col: str, shard_size: int) -> Column:
    """contiguous shard number [start, stop) of ``shard_size`` rows."""
    return F.floor(F.col(index_col) / F.lit(shard_size)).cast("bigint")


def limit_rows(df: DataFrame, order: Sequence[str | Column], n: int | None) -> DataFrame:
    """the first ``n`` rows in order (None keeps all)."""
    if n is None:
        return df
    if n <= TOPK_LIMIT:
        return df.orderBy(*_ord(order)).limit(n)
    return global_index(df, order, "_i").filter(F.col("_i") < n).drop("_i")


def hash_shuffle_key(seed: int | str, *cols: str | Column) -> Column:
    """seeded shuffle order (SHA-256 of seed and key)."""
    return seeded_order_key(seed, *cols)


def first_by_hash(df: DataFrame, seed: int | str, key: Sequence[str], n: int) -> DataFrame:
    """F6 cap / F14 sample: the first ``n`` rows of the seeded shuffle."""
    keyed = df.withColumn("_h", hash_shuffle_key(seed, *key))
    return limit_rows(keyed, ["_h"], n).drop("_h")


def cap_split(df: DataFrame, split_col: str, split: str, max_rows: int, seed: int | str, key: Sequence[str]) -> DataFrame:
    """at most ``max_rows`` rows of one split, the first of its seeded shuffle (by a key
    that tells its rows apart); the other splits, and rows without one, stay whole."""
    of_split = F.coalesce(F.col(split_col) == split, F.lit(False))
    return first_by_hash(df.where(of_split), seed, key, max_rows).unionByName(df.where(~of_split))


def split_three_way(df: DataFrame, seed: int | str, key: Sequence[str],
                    test_size: float = 0.2, inner_test_size: float = 0.2,
                    exact: bool = True, names=("train", "valid", "test"), copy_below: int = 0) -> DataFrame:
    """seeded 80/16/4 split (``test_size`` off train, then
    ``inner_test_size`` of that to test, the rest valid).

    Exact mode: rows ranked by the seeded hash; the first ceil(n*0.2) form the
    held-out part, whose first ceil(m*0.2) are test. With fewer than ``copy_below``
    rows every split holds all rows (callers of the 80/16/4 rule pass 5). Cheap
    mode uses a hash threshold and needs no positions.
    """
    train, valid, test = names
    keyed = df.withColumn("_h", hash_shuffle_key(seed, *key))
    if not exact:
        u = F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(16 ** 13)
        split = (F.when(u < test_size * inner_test_size, test)
                 .when(u < test_size, valid).otherwise(train))
        return keyed.withColumn("split", split).drop("_h")
    n = df.count()
    if n < copy_below:
        return (df.withColumn("split", F.explode(F.array(*[F.lit(x) for x in names]))))
    n_rest = math.ceil(test_size * n)
    n_test = math.ceil(inner_test_size * n_rest)
    idx = global_index(keyed, ["_h"], "_i")
    split = (F.when(F.col("_i") < n_test, test)
             .when(F.col("_i") < n_rest, valid).otherwise(train))
    return idx.withColumn("split", split).drop("_h", "_i")


def ensure_splits(df: DataFrame, seed: int | str, key: Sequence[str],
                  split_col: str = "split") -> DataFrame:
    """F8: make train/test/valid from whatever splits exist.

    ``validation`` is an alias of ``valid`` where there is no ``valid`` (else its
    rows are left out); without ``train`` the first split (by name) is split
    80/16/4; with train only, the same; with train and test but no valid, 10 % of
    train becomes valid (train of one row is copied); without test, test is a copy
    of valid. Decided on the small set of distinct split names.
    """
    raw = [r[0] for r in df.select(split_col).distinct().collect()]  # few names
    if not raw:
        return df
    named = df
    if "valid" not in raw and "validation" in raw:
        named = df.withColumn(split_col, F.when(F.col(split_col) == "validation", "valid").otherwise(F.col(split_col)))
    names = sorted("valid" if x == "validation" and "valid" not in raw else x for x in raw if x is not None)
    only = None
    if "train" not in names:
        only = names[0]
    elif "test" not in names and "valid" not in names:
        only = "train"
    if only is not None:
        return split_three_way(named.filter(F.col(split_col) == only).drop(split_col), seed, key, copy_below=5)
    # decided from here on: train and one of test, valid; rows of other names are left out
    named = named.filter(F.col(split_col).isin("train", "test", "valid"))
    parts = {s: named.filter(F.col(split_col) == s) for s in ("train", "test", "valid") if s in names}
    if "valid" not in names:
        train = cut_lineage(parts["train"].drop(split_col))
        if train.limit(2).count() < 2:
            parts["valid"] = train.withColumn(split_col, F.lit("valid"))
        else:
            tv = split_three_way(train, seed, key, test_size=0.1, inner_test_size=0.0)
            tv = tv.withColumn(split_col, F.when(F.col(split_col) == "train", "train").otherwise("valid"))
            parts["train"] = tv.filter(F.col(split_col) == "train")
            parts["valid"] = tv.filter(F.col(split_col) == "valid")
    if "test" not in names:
        parts["test"] = parts["valid"].withColumn(split_col, F.lit("test"))
    return parts["train"].unionByName(parts["test"]).unionByName(parts["valid"])


def worst_k(df: DataFrame, value: str, tiebreak: str, k: int = 15) -> DataFrame:
    """rows with the largest ``value`` (ties by ``tiebreak``), head k."""
    return df.orderBy(F.desc(value), F.asc(tiebreak)).limit(k)


def oversample(df: DataFrame, k: int) -> DataFrame:
    """every row k times (with a ``copy`` number)."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


#: draws of one row that are made where the row is
DRAWS = 1 << 16


def weighted_interleave(df: DataFrame, source_col: str, order: Sequence[str],
                        weights: DataFrame, stopping: str = "all_exhausted") -> DataFrame:
    """mix sources with probabilities p_i = w_i / sum(w) (``weights``:
    source, weight as integers).

    all_exhausted: N = max(n_i / p_i); source i supplies ceil(N * p_i) rows,
    cycling through its rows; first_exhausted uses min. Rows are merged by
    ``mix_key`` = (draw + 1) / p_i, then source. Deterministic, with the
    reference's expected shares; exact integer arithmetic for the counts:
    with j the bounding source, ceil(N p_i) = ceil(n_j w_i / w_j).
    """
    counts = df.groupBy(source_col).agg(F.count(F.lit(1)).alias("_n"))
    cp = null_safe_join(counts, weights.select(source_col, F.col("weight").cast("bigint").alias("_w")),
                        [source_col], "left")
    no_weight = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce(F.col(source_col), F.lit("NULL"))))
    cp = cp.withColumn("_w", F.when(F.col("_w").isNull(), no_weight.cast("bigint")).otherwise(F.col("_w")))
    ratio = F.col("_n").cast("double") / F.col("_w")
    pick = F.max_by if stopping == "all_exhausted" else F.min_by
    bound = cp.agg(pick(F.struct(F.col("_n").alias("bn"), F.col("_w").alias("bw")), ratio).alias("_b"),
                   F.sum("_w").alias("_wsum"))
    plan = (cp.crossJoin(F.broadcast(bound))  # one-row table
            .withColumn("_m", F.expr("(_b.bn * _w + _b.bw - 1) div _b.bw"))
            .withColumn("_start", F.coalesce(F.sum("_n").over(
                Window.orderBy(source_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # Position inside the source = global position - rows of earlier sources
    # (offsets from the small per-source table, no per-source window).
    idx = global_index(df, [F.col(source_col), *_ord(order)], "_g")
    rows = (idx.join(plan.select(source_col, "_n", "_m", "_start", "_w", "_wsum"), source_col)
            .withColumn("_k", F.col("_g") - F.col("_start"))
            .filter(F.col("_k") < F.col("_m")))
    # a row of a small source is drawn many times: its draws are cut into intervals, the
    # intervals are dealt over the cluster without the row, and meet it again there
    copies = F.floor((F.col("_m") - 1 - F.col("_k")) / F.col("_n")).cast("bigint") + 1
    rows = rows.withColumn("_copies", copies)
    once = rows.filter(F.col("_copies") <= DRAWS).withColumn(
        "_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))).drop("_copies")
    often = rows.filter(F.col("_copies") > DRAWS)
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / DRAWS))
    spans = often.select("_g", "_copies", F.explode(parts).alias("_part"))
    spans = spans.repartition("_g", "_part").withColumn("_r", F.explode(F.sequence(
        F.col("_part") * DRAWS, F.least((F.col("_part") + 1) * DRAWS, F.col("_copies")) - 1)))
    many = spans.select("_g", "_r").join(often.drop("_copies"), "_g")
    return (once.unionByName(many.select(*once.columns))
            .withColumn("draw", (F.col("_k") + F.col("_r") * F.col("_n")).cast("bigint"))
            .withColumn("mix_key", F.round((F.col("draw") + 1) * F.col("_wsum") / F.col("_w"), 6))
            .drop("_g", "_n", "_m", "_start", "_w", "_wsum", "_k", "_r"))


def char_budget(df: DataFrame, order: Sequence[str], chars: str | Column, batch_size: int,
                budget: int) -> DataFrame:
    """whole batches of ``batch_size`` rows (in order) until the stripped
    character total reaches ``budget``; a batch is kept when the total before
    it is still below the budget."""
    idx = global_index(df, order, "_i").withColumn("batch", F.floor(F.col("_i") / batch_size))
    c = F.col(chars) if isinstance(chars, str) else chars
    sums = idx.groupBy("batch").agg(F.sum(c).cast("bigint").alias("_s"))
    cum = running_total(sums, ["batch"], "_s", "_cum")
    keep = cum.filter(F.col("_cum") - F.col("_s") < budget).select("batch")
    return idx.join(keep, "batch", "left_semi").drop("_i")


def no_duplicate_batches(df: DataFrame, text_col: str, seed: int | str, key: Sequence[str],
                         batch_size: int) -> DataFrame:
    """F16: batches of ``batch_size`` in which no text occurs twice.

    A row's round is its occurrence number among equal texts (seeded hash
    order); rows of one round hold distinct texts, so each round is cut into
    consecutive batches (a round's last batch may be short). Occurrence
    numbers come from positions in (text, hash) order minus the text's first
    position, so a text repeated a million times never forms one task.
    """
    h = hash_shuffle_key(seed, *key)
    th = F.sha2(F.col(text_col), 256)
    keyed = df.withColumn("_th", th).withColumn("_h", h)
    pos = global_index(keyed, ["_th", "_h"], "_p")
    first = pos.groupBy("_th").agg(F.min("_p").alias("_p0"))
    rounds = pos.join(first, "_th").withColumn("round", (F.col("_p") - F.col("_p0")).cast("bigint"))
    rpos = global_index(rounds.drop("_p", "_p0"), ["round", "_h"], "_q")
    starts = rpos.groupBy("round").agg(F.min("_q").alias("_q0"))
    # One row per round; AQE broadcasts it when small.
    return (rpos.join(starts, "round")
            .withColumn("batch_in_round", F.floor((F.col("_q") - F.col("_q0")) / batch_size)
                        .cast("bigint"))
            .drop("_th", "_h", "_q", "_q0"))

