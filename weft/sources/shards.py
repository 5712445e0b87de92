"""Corpora as committed shards: build, check, open, and embed them shard by shard.

A corpus folder holds build folders and one marker. A build writes its shards (one file per
(split, shard), at most N rows, by position in the split) and a table of them below a new
folder that nobody reads; the marker, which names that folder, is renamed into place last.
So readers see a whole corpus or none, whatever a killed job leaves behind.

Embeddings are computed for the shards that a commit table does not have yet for the same
configuration; every wave of shards is committed on its own, so a run that was killed
goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators import corpus as C
from weft.operators.embed import EncoderFactory, encoder_embedding
from weft.operators.ordering import null_safe_join, positions_in_group
from weft.operators.profile import fingerprint
from weft.session import cut_lineage
from weft.sources.files import DataError

MARKER = "_CORPUS.json"
FORMAT_VERSION = 2
SHARD_ROWS = 10_000
#: rows of a shard list read by the driver for one wave of embeddings
WAVE = 256
#: rows of small shards that one task takes at least
TASK_ROWS = 10_000
_VECTOR_FIELDS = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("split", T.StringType()),
                  T.StructField("shard", T.IntegerType())]


# ---- the file system of the session ----

def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole or not at all: under another name first, then renamed."""
    fs, at = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if not fs.rename(draft, at):
        raise DataError(f"{path} exists already")


# ---- shards ----

def _tasks(spark: SparkSession, shards: int, rows: int) -> int:
    """Tasks for ``shards`` of ``rows`` rows in all: one a shard, fewer where shards are small
    and all cores are busy."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(shards, max(3 * cores, -(-rows // TASK_ROWS))))


def write_shards(corpus: DataFrame, path: str, order: Sequence[str], settings: dict | None = None,
                 split_col: str = "split", id_col: str = "id", shard_rows: int = SHARD_ROWS) -> dict:
    """Write ``corpus`` as shards of at most ``shard_rows`` rows per split, in ``order``
    (a total order inside a split), and commit them. Returns the marker's content: counts per
    split and source, fingerprint, settings and the build folder.

    A path that holds a committed corpus, or builds without one, raises (``open_or_none``).
    An empty corpus is a corpus of no shards. Further columns are kept.
    """
    if shard_rows <= 0:
        raise ValueError("shard_rows must be positive")
    spark = corpus.sparkSession
    if open_or_none(spark, path) is not None:
        raise DataError(f"{path} holds a corpus already")
    build = f"build-{uuid.uuid4().hex}"
    base = f"{path.rstrip('/')}/{build}"
    corpus = cut_lineage(corpus)
    # the positions are of (split, order) alone; the rows move once, to their shard
    place = positions_in_group(corpus.select(split_col, *order), [split_col], list(order), "_at")
    placed = null_safe_join(corpus, place, [split_col, *order])
    sharded = placed.withColumn("shard", F.floor(F.col("_at") / shard_rows).cast("int"))
    rows = sharded.select(F.count(F.lit(1))).first()[0]
    dealt = sharded.repartition(_tasks(spark, -(-rows // shard_rows), rows), split_col, "shard").sortWithinPartitions(
        split_col, "shard", "_at").drop("_at")
    dealt.write.partitionBy(split_col, "shard").parquet(f"{base}/rows")
    files = (spark.read.parquet(f"{base}/rows") if rows else spark.createDataFrame([], sharded.drop("_at").schema))
    listed = _listed(files, split_col) if rows else spark.createDataFrame([], f"{split_col} string, shard int, file string, rows long")
    first = F.col("shard").cast("long") * shard_rows
    listed.select(split_col, "shard", first.alias("start"), (first + F.col("rows")).alias("stop"), "rows", "file").sort(
        split_col, "shard").write.parquet(f"{base}/shards")
    cells = {(r[0], r[1]): r[2] for r in corpus.groupBy(split_col, "source").agg(F.count(F.lit(1))).collect()}
    marker = {"format_version": FORMAT_VERSION, "build": build, "row_count": rows, "shard_rows": shard_rows,
              "split_col": split_col, "shards": spark.read.parquet(f"{base}/shards").count(),
              "split_counts": _add(cells, 0), "source_counts": _add(cells, 1),
              "fingerprint": fingerprint(corpus, id_col).first()["fingerprint"] if rows else "",
              "id_col": id_col, "settings": settings or {}}
    _write_text(spark, f"{path.rstrip('/')}/{MARKER}", json.dumps(marker, sort_keys=True, ensure_ascii=False))
    return marker


def _add(cells: dict, by: int) -> dict:
    out: dict[str, int] = {}
    for key, n in cells.items():
        name = "" if key[by] is None else str(key[by])
        out[name] = out.get(name, 0) + n
    return dict(sorted(out.items()))


def _listed(rows: DataFrame, split_col: str) -> DataFrame:
    """(split, shard, file, rows) of the files; without data columns Spark reads footers only."""
    return rows.groupBy(F.col(split_col).cast("string").alias(split_col), F.col("shard").cast("int").alias("shard"),
                        F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def open_or_none(spark: SparkSession, path: str) -> dict | None:
    """The marker of a committed corpus, None if there is nothing; builds without a marker raise."""
    if _exists(spark, f"{path.rstrip('/')}/{MARKER}"):
        return json.loads(_read_text(spark, f"{path.rstrip('/')}/{MARKER}"))
    if any(c.startswith("build-") for c in _children(spark, path)):
        raise DataError(f"incomplete corpus at {path}; remove it before building again")
    return None


def _marker(spark: SparkSession, path: str) -> dict:
    marker = open_or_none(spark, path)
    if marker is None:
        raise DataError(f"no corpus at {path}")
    return marker


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """(split, shard, start, stop, rows, file) of a committed corpus."""
    return spark.read.parquet(f"{path.rstrip('/')}/{_marker(spark, path)['build']}/shards")


def open_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The rows of a committed corpus; ``split`` and ``shard`` prune folders."""
    marker = _marker(spark, path)
    base = f"{path.rstrip('/')}/{marker['build']}/rows"
    if not marker["row_count"]:
        return spark.createDataFrame([], f"{marker['id_col']} string, {marker['split_col']} string, shard int")
    rows = spark.read.parquet(base)
    return rows if split is None else rows.where(F.col(marker["split_col"]) == split)


def check_corpus(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(check, expected, actual) of what is wrong with a committed corpus (empty: valid):
    the version, shards whose file is gone, files that no shard names, row counts of files, the
    total, and with ``deep`` the fingerprint of the ids. Row counts come from the footers."""
    marker = _marker(spark, path)
    base = f"{path.rstrip('/')}/{marker['build']}"
    split = marker["split_col"]
    want = spark.read.parquet(f"{base}/shards").select(F.col(split).cast("string").alias("s"), "shard", "rows",
                                                       F.element_at(F.split("file", "/"), -1).alias("file"))
    issues = []
    if marker["format_version"] != FORMAT_VERSION:
        issues.append(("format_version", str(FORMAT_VERSION), str(marker["format_version"])))
    there = any(c.startswith(f"{split}=") for c in _children(spark, f"{base}/rows"))
    have = spark.createDataFrame([], "s string, shard int, file string, n long")
    if there:
        have = _listed(spark.read.parquet(f"{base}/rows"), split).select(
            F.col(split).alias("s"), "shard", F.element_at(F.split("file", "/"), -1).alias("file"), F.col("rows").alias("n"))
    have = cut_lineage(have)
    total = have.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total != marker["row_count"]:
        issues.append(("row_count", str(marker["row_count"]), str(total)))
    if deep and there:
        found = fingerprint(spark.read.parquet(f"{base}/rows"), marker["id_col"]).first()["fingerprint"]
        if found != marker["fingerprint"]:
            issues.append(("fingerprint", marker["fingerprint"], found))
    both = null_safe_join(want, have, ["s", "shard", "file"], "left")
    name = F.concat_ws("/", "s", "shard")
    lost = both.where("n IS NULL").select(F.concat(F.lit("missing:"), name).alias("check"),
                                          F.col("rows").cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    other = both.where("n <> rows").select(F.concat(F.lit("rows:"), name).alias("check"),
                                           F.col("rows").cast("string").alias("expected"), F.col("n").cast("string").alias("actual"))
    extra = have.join(want.select("s", "shard", "file"), ["s", "shard", "file"], "left_anti").select(
        F.concat(F.lit("unlisted:"), name).alias("check"), F.lit(None).cast("string").alias("expected"),
        F.col("n").cast("string").alias("actual"))
    return spark.createDataFrame(issues, "check string, expected string, actual string").unionByName(lost).unionByName(
        other).unionByName(extra)


# ---- the corpus build in one call ----

def quota_rows(rows: DataFrame, total: int, order: Sequence[str], shares: Sequence[int] = (60, 20, 20),
               fixed: int = 2) -> DataFrame:
    """``total`` of the unique rows: the first ``fixed`` sources (by name) give their
    share, the others fill the last share one row a round; too few rows raise."""
    names = rows.select("source").distinct()
    quotas = cut_lineage(C.corpus_quotas(names, total, "source", shares, fixed))
    first = {r.source: r.quota for r in quotas.sort("source").limit(fixed).collect()}
    given = quotas.where(F.col("source").isin(list(first)))
    parts = C.take_quota(rows.where(F.col("source").isin(list(first))), given, "source", list(order))
    rest = total - sum(first.values())
    if rest:
        other = rows.where(F.col("source").isNull() | ~F.col("source").isin(list(first)))
        parts = parts.unionByName(C.round_robin_quota(other, "source", list(order), rest).drop("round"))
    return parts


def build_or_open_corpus(docs: DataFrame, path: str, total: int, order: Sequence[str] = ("doc_id",),
                         shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict]:
    """The corpus of ``total`` rows at ``path``: built once, else checked and opened.

    ``docs`` (doc_id, text, source, ...) are cleaned, blank rows dropped, ids made and exact
    copies removed; ``quota_rows`` draws from each source, rows are split by their id, written
    as shards and committed. A corpus that was built with other settings, that lacks files, or
    that was never committed raises, as does a source with too few rows.
    """
    if total <= 0:
        raise ValueError("the corpus size must be positive")
    spark = docs.sparkSession
    settings = {"total": total, "shares": [60, 20, 20], "shard_rows": shard_rows}
    marker = open_or_none(spark, path)
    if marker is None:
        rows = cut_lineage(C.prepare_corpus_rows(docs))
        picked = quota_rows(rows, total, order)
        marker = write_shards(picked.withColumn("split", C.hash_split("id")), path, order, settings, shard_rows=shard_rows)
    else:
        if marker["settings"] != settings:
            raise DataError(f"the corpus at {path} was built with {marker['settings']}, not {settings}")
        wrong = check_corpus(spark, path).limit(3).collect()
        if wrong:
            raise DataError(f"the corpus at {path} is damaged: {[tuple(r) for r in wrong]}")
    return open_corpus(spark, path), marker


# ---- embeddings that can be resumed ----

def config_hash(config: dict) -> str:
    """Name of a configuration: any difference (model, prompt, dimension, corpus) gives another."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]


def _commits(spark: SparkSession, base: str) -> DataFrame:
    schema = "split string, shard int, rows long, dimension int, folder string"
    if not _exists(spark, f"{base}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/commits")


def embed_corpus(spark: SparkSession, path: str, out: str, factory: EncoderFactory, dim: int, model: str,
                 prompt: str = "", wave: int = WAVE, text_col: str = "text") -> tuple[DataFrame, dict]:
    """E5 + H1: vectors of all shards of the corpus at ``path``, below ``out``; shards that
    are committed there for the same configuration are not computed again.

    The configuration is the model's name, prompt, dimension, and the corpus fingerprint.
    Shards are computed in waves of ``wave``, small ones several in a task; a wave is visible once
    its commit rows are. Returns the vectors (id, embedding, split, shard) and what was done.
    """
    marker = _marker(spark, path)
    split, key = marker["split_col"], marker["id_col"]
    config = {"model": model, "prompt": prompt, "dimension": dim, "normalized": False, "corpus": marker["fingerprint"],
              "shard_rows": marker["shard_rows"]}
    base = f"{out.rstrip('/')}/{config_hash(config)}"
    if not _exists(spark, f"{base}/config.json"):
        _write_text(spark, f"{base}/config.json", json.dumps(config, sort_keys=True, ensure_ascii=False))
    listed = shard_table(spark, path).select(F.col(split).cast("string").alias("split"), "shard", "rows")
    todo = cut_lineage(listed.join(_commits(spark, base).select("split", "shard"), ["split", "shard"], "left_anti"))
    waiting = todo.count()
    skipped, computed = listed.count() - waiting, 0
    rows = open_corpus(spark, path)
    here = T.StructType([rows.schema[key], *_VECTOR_FIELDS])
    last = None
    while computed < waiting:
        rest = todo if last is None else todo.where((F.col("split") > last.split) | (F.col("split") == last.split)
                                                    & (F.col("shard") > last.shard))
        now = rest.sort("split", "shard").limit(wave).collect()
        if not now:
            raise DataError("a shard without a split can't be embedded")
        last = now[-1]
        folder = f"wave={uuid.uuid4().hex}"
        # literal folders, so that only theirs are read
        these = F.lit(False)
        for s in sorted({r.split for r in now}):
            these = these | ((F.col(split) == s) & F.col("shard").isin([r.shard for r in now if r.split == s]))
        part = rows.where(these).withColumn("_key", F.struct(F.col(key), F.col(split).cast("string").alias("split"), "shard"))
        part = part.repartition(_tasks(spark, len(now), sum(r.rows for r in now)), split, "shard")
        made = encoder_embedding(part, "_key", text_col, factory, dim, prompt)
        made.select(f"_key.{key}", "embedding", "_key.split", "_key.shard").write.partitionBy("split", "shard").parquet(
            f"{base}/{folder}")
        got = {(r.split, r.shard): r.n for r in spark.read.schema(here).parquet(f"{base}/{folder}").groupBy(
            "split", "shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        wrong = [(r.split, r.shard) for r in now if got.get((r.split, r.shard)) != r.rows]
        if wrong:
            raise DataError(f"shards with another number of vectors than rows: {wrong[:5]}")
        spark.createDataFrame([(r.split, r.shard, r.rows, dim, folder) for r in now],
                              "split string, shard int, rows long, dimension int, folder string").coalesce(1).write.mode(
            "append").parquet(f"{base}/commits")
        computed += len(now)
    folders = sorted(r[0] for r in _commits(spark, base).select("folder").distinct().collect())  # one per wave
    if not folders:
        raise DataError("the corpus has no rows to embed")
    # the folders of all waves are listed at once; those named "wave-" are of an older layout
    parts = [spark.read.parquet(f"{base}/{f}") for f in folders if "=" not in f]
    new = [f"{base}/{f}" for f in folders if "=" in f]
    if new:
        parts.append(spark.read.schema(here).option("basePath", base).parquet(*new))
    vectors = parts[0].select(key, "embedding", "split", "shard")
    for one in parts[1:]:
        vectors = vectors.unionByName(one.select(key, "embedding", "split", "shard"))
    return vectors, {"config": config, "folder": base, "skipped": skipped, "computed": computed}
