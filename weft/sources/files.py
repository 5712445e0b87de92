"""File sources and sinks (A1-A12): NDJSON with declared schemas, audited
NDJSON, multi-file reads with a running id, partitioned Parquet layouts,
shards, manifests and CSV.

Schemas are always declared (never inferred). Layouts use partition
columns (config, split) so reads prune directories; writes go through
Spark's commit protocol, so a shard set is visible only when complete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.ordering import global_index
from weft.operators.profile import fingerprint
from weft.session import cut_lineage, ensure_checkpoint_dir

CORRUPT = "_corrupt_record"


class DataError(ValueError):
    """Input data violates a declared contract."""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/weft-scratch/{name}-{uuid.uuid4().hex}"


def scan_ndjson(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str,
                mode: str = "FAILFAST") -> DataFrame:
    """A1: newline-delimited JSON with a declared schema; unknown fields are
    ignored, a malformed line fails the job (FAILFAST)."""
    return spark.read.schema(schema).option("mode", mode).json(paths)


def scan_ndjson_audit(spark: SparkSession, paths: str | Sequence[str],
                      schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """A2: parse line by line; return (good rows, bad lines with file and raw
    text). Reading lines as text and parsing with ``from_json`` keeps the
    raw line and its file for every failure."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    lines = (spark.read.text(paths)
             .select(F.col("value"), F.col("_metadata.file_path").alias("file"))
             .filter(F.trim(F.col("value")) != ""))
    parsed = lines.select("file", "value", F.from_json(
        "value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j"))
    good = parsed.filter(F.col(f"j.{CORRUPT}").isNull()).select(
        *[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.filter(F.col(f"j.{CORRUPT}").isNotNull()).select("file", F.col("value").alias("line"))
    return good, bad


def raise_if_rows(bad: DataFrame, what: str) -> None:
    """Fail with a sample of the offending rows when ``bad`` is not empty."""
    sample = bad.limit(5).collect()
    if sample:
        raise DataError(f"{what}: {len(sample)}+ bad rows, e.g. {sample[:3]}")


def require_columns(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A3: missing columns raise; unexpected columns are reported; the frame
    is projected to the required order."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise DataError(f"missing columns: {missing}")
    unexpected = [c for c in df.columns if c not in required]
    return df.select(*required), unexpected


def scan_glob(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str,
              id_col: str = "sample_id") -> DataFrame:
    """A4: many NDJSON files in file-name order, lines in file order, one
    running id over all of them.

    File order = path; line order inside a file = (split start, row number
    in the split). Positions come from ``global_index`` (no global window).
    """
    df = scan_ndjson(spark, paths, schema)
    keyed = (df.withColumn("_file", F.col("_metadata.file_path"))
             .withColumn("_start", F.col("_metadata.file_block_start"))
             .withColumn("_row", F.monotonically_increasing_id()))
    return global_index(keyed, ["_file", "_start", "_row"], id_col).drop("_file", "_start", "_row")


def write_layout(df: DataFrame, path: str, partition_cols: Sequence[str] = ("config", "split"),
                 max_records: int | None = None, mode: str = "overwrite") -> None:
    """Partitioned Parquet; ``max_records`` caps rows per file
    (shards). Dynamic overwrite replaces only the partitions being written."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.partitionBy(*partition_cols).parquet(path)


def load_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               config: str | None = None, split: str | None = None,
               limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Open a (config, split) layout; filters on partition columns
    prune directories. An empty selection keeps the schema. ``limit`` keeps
    the first rows by ``order``."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    if config is not None:
        df = df.filter(F.col("config") == config)
    if split is not None:
        df = df.filter(F.col("split") == split)
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df


def corpus_manifest(corpus: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: row count, counts per split and per source, order-free
    fingerprint, and the id / split algorithms."""
    # both maps from one aggregate of the corpus: a row per (split, source)
    cells = cut_lineage(corpus.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n")))

    def counts(by: str) -> DataFrame:
        return cells.groupBy(by).agg(F.sum("n").alias("n")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(f"{by}_counts"))

    split_counts, source_counts = counts("split"), counts("source")
    fp = fingerprint(corpus, id_col)
    return (fp.crossJoin(split_counts).crossJoin(source_counts)  # one-row tables
            .select(F.lit(2).alias("format_version"), F.col("rows").alias("row_count"),
                    "split_counts", "source_counts", "fingerprint",
                    # fixed values: readers of a manifest compare them
                    F.lit("sha256(source\\0text)").alias("id_algorithm"),
                    F.lit("first-64-bits(id) modulo 100; validation < 2").alias("split_algorithm")))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def validate_manifest(manifest: DataFrame, corpus: DataFrame, expected_total: int,
                      expected_quotas: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Differences between a manifest and the data (empty = valid):
    version, total, fingerprint of the ids, per-split and per-source counts (full
    outer join of the count tables), and optional per-source quotas."""
    m = manifest.first()  # one row
    issues = []
    spark = corpus.sparkSession
    if m["format_version"] != 2:
        issues.append(("format_version", "2", str(m["format_version"])))
    if m["row_count"] != expected_total:
        issues.append(("row_count", str(expected_total), str(m["row_count"])))
    print_ = fingerprint(corpus, id_col).first()["fingerprint"]
    if m["fingerprint"] != print_:
        issues.append(("fingerprint", m["fingerprint"], print_))
    out = spark.createDataFrame(issues, "check string, expected string, actual string")
    cells = cut_lineage(corpus.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n")))
    for by in ("split", "source"):
        counts = m[f"{by}_counts"]  # a map, or a struct when read back from JSON
        counts = counts.asDict() if hasattr(counts, "asDict") else counts
        want = spark.createDataFrame([(k, int(v)) for k, v in counts.items() if v is not None], f"{by} string, expected bigint")
        got = cells.groupBy(by).agg(F.sum("n").alias("actual"))
        out = out.unionByName(want.join(got, by, "full_outer")
                              .filter(~F.col("expected").eqNullSafe(F.col("actual")))
                              .select(F.concat(F.lit(f"{by}_count:"), F.col(by)).alias("check"),
                                      F.col("expected").cast("string"), F.col("actual").cast("string")))
    if expected_quotas is not None:
        got = cells.groupBy("source").agg(F.sum("n").alias("actual"))
        q = (expected_quotas.join(got, "source", "full_outer")
             .filter(~F.col("quota").eqNullSafe(F.col("actual")))
             .select(F.concat(F.lit("quota:"), F.col("source")).alias("check"),
                     F.col("quota").cast("string").alias("expected"), F.col("actual").cast("string")))
        out = out.unionByName(q)
    return out


def discover_layout(df: DataFrame, configs: Sequence[str] | None = None,
                    splits: Sequence[str] | None = None) -> DataFrame:
    """A10: the (config, split) pairs present; requested names that do not
    exist raise."""
    layout = df.select("config", "split").distinct()
    spark = df.sparkSession
    for col, names in (("config", configs), ("split", splits)):
        if names:
            req = spark.createDataFrame([(n,) for n in names], f"{col} string")
            unknown = req.join(layout.select(col).distinct(), col, "left_anti")
            raise_if_rows(unknown, f"unknown {col} requested")
            layout = layout.filter(F.col(col).isin(*names))
    return layout


def save_config(df: DataFrame, path: str, skip_existing: bool = False) -> DataFrame:
    """Overwrite only the configs present in ``df``; with
    ``skip_existing`` configs already on disk are left alone. Returns the
    rows written."""
    spark = df.sparkSession
    todo = df
    if skip_existing and _exists(spark, path):
        existing = spark.read.parquet(path).select("config").distinct()
        todo = df.join(existing, "config", "left_anti")
    write_layout(todo, path, ("config", "split"))
    return todo


def _exists(spark: SparkSession, path: str) -> bool:
    """Path test through the session's file system (works for any Hadoop URI)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: rows of a table that is written as one CSV file
MAX_CSV_ROWS = 1_000_000


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header. For tables of metrics: more than ``MAX_CSV_ROWS`` rows
    are an error, as one task writes them."""
    if df.limit(MAX_CSV_ROWS + 1).count() > MAX_CSV_ROWS:
        raise DataError(f"more than {MAX_CSV_ROWS} rows are no table of metrics")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def manifest_json(manifest: DataFrame) -> str:
    """The manifest row as JSON text (for a metadata file)."""
    return json.dumps(manifest.first().asDict(recursive=True), sort_keys=True)
