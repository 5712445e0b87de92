"""Registered source/sink and streaming queries.

Each query writes what it needs under the session's checkpoint directory
(a fresh scratch folder per run), then reads it back with the operator
under test, so the result is checked against the driver tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.hashing import hex64_mod
from weft.operators.corpus import prepare_corpus_rows
from weft.operators.profile import share_by_group
from weft.plans import sqlfrag as S
from weft.plans.fixtures import CORPUS_SPLIT_SQL, corpus_with_split
from weft.session import table
from weft.sources import files as IO
from weft.sources.datasets import parquet_datasets
from weft.sources import loader as L
from weft.sources import shards as SH
from weft.streaming import corpus as ST

QUERIES: dict = {}
ORACLE: dict = {}

CONV_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
CORPUS_FILE_SCHEMA = ("doc_id bigint, id string, text string, lang string, source string, "
                      "config string, split string")


def scan_ndjson(spark, sf):
    """A1: conversations round-tripped through NDJSON (plus an unknown field)."""
    path = IO.scratch_path(spark, "ndjson")
    table(spark, sf, "conversations").withColumn("extra", F.lit("ignored")).write.json(path)
    return IO.scan_ndjson(spark, path, CONV_SCHEMA)


QUERIES["scan_ndjson"] = scan_ndjson
ORACLE["scan_ndjson"] = "SELECT conv_id, turn, role, text FROM conversations"

def _bucket():
    """Hash bucket 0..99 of (conv_id, turn)."""
    return hex64_mod(F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"),
                                     F.col("turn").cast("string")), 256), 100)


def named_datasets(spark, sf):
    """Rows of each text table, loaded by name, one of them through SQL."""
    data = parquet_datasets(spark, sf)
    out = None
    for name in ("documents", "benchmark", "conversations"):
        data.get(name)
        one = spark.sql(f"SELECT '{name}' AS name, count(*) AS rows, count(text) AS texts FROM {name}")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["named_datasets"] = named_datasets
ORACLE["named_datasets"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS rows, count(text) AS texts FROM {n}" for n in ("documents", "benchmark", "conversations"))


def pluggable_loader(spark, sf):
    """Conversations written by the sink and read back by a loader, a partition a file."""
    L.register_sink(spark)
    L.register_loader(spark, "ndjson_loader", L.NdjsonLoader(), CONV_SCHEMA)
    path = IO.scratch_path(spark, "loader")
    table(spark, sf, "conversations").repartition(3).write.format("ndjson_sink").mode("append").save(path)
    return spark.read.format("ndjson_loader").option("path", path).load()


QUERIES["pluggable_loader"] = pluggable_loader
ORACLE["pluggable_loader"] = "SELECT conv_id, turn, role, text FROM conversations"


def scan_ndjson_audit(spark, sf):
    """A2: NDJSON where about 5 % of lines are cut short; good and bad counts."""
    path = IO.scratch_path(spark, "ndjson-audit")
    c = table(spark, sf, "conversations")
    line = F.to_json(F.struct(*[F.col(f.name) for f in CONV_SCHEMA.fields]))
    broken = F.when(F.col("_b") < 5, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    c.select(line.alias("value"), _bucket().alias("_b")).select(
        broken.alias("value")).write.text(path)
    good, bad = IO.scan_ndjson_audit(spark, path, CONV_SCHEMA)
    g = good.agg(F.count(F.lit(1)).alias("good_rows"))
    b = bad.agg(F.count(F.lit(1)).alias("bad_lines"))
    return g.crossJoin(b)  # two one-row tables


QUERIES["scan_ndjson_audit"] = scan_ndjson_audit
_BUCKET_SQL = S.hex_mod100("sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))")
ORACLE["scan_ndjson_audit"] = f"""
SELECT CAST(count_if({_BUCKET_SQL} >= 5) AS BIGINT) AS good_rows, CAST(count_if({_BUCKET_SQL} < 5) AS BIGINT) AS bad_lines FROM conversations
"""


def require_columns(spark, sf):
    """A3: project documents to the required columns, in order."""
    out, _unexpected = IO.require_columns(table(spark, sf, "documents"), ["text", "doc_id", "source"])
    return out.withColumn("text", F.sha2("text", 256))


QUERIES["require_columns"] = require_columns
ORACLE["require_columns"] = "SELECT sha256(text) AS text, doc_id, source FROM documents"


def scan_glob(spark, sf):
    """A4: documents written as NDJSON files per language, read back in file
    order with one running sample id."""
    path = IO.scratch_path(spark, "glob")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    (d.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
     .write.option("maxRecordsPerFile", 100).partitionBy("lang").json(path))
    return IO.scan_glob(spark, path, "doc_id bigint, source string")


QUERIES["scan_glob"] = scan_glob
ORACLE["scan_glob"] = """
SELECT doc_id, source, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS sample_id FROM documents
"""


def _layout(spark, sf, name):
    path = IO.scratch_path(spark, name)
    c = corpus_with_split(spark, sf).withColumn("config", F.col("lang"))
    IO.write_layout(c.select("doc_id", "id", "text", "lang", "source", "config", "split"), path,
                    ("config", "split"), max_records=100)
    return path


def load_split(spark, sf):
    """A5: one (config, split) of a partitioned layout (directory pruning)."""
    path = _layout(spark, sf, "layout")
    return IO.load_split(spark, path, CORPUS_FILE_SCHEMA, config="en", split="train").select("doc_id", "id")


QUERIES["load_split"] = load_split
ORACLE["load_split"] = f"""
WITH {CORPUS_SPLIT_SQL} SELECT doc_id, id FROM corpus_split WHERE lang = 'en' AND split = 'train'
"""


def _shards(spark, sf, name):
    path = IO.scratch_path(spark, name)
    c = corpus_with_split(spark, sf).select("doc_id", "id", "text", "lang", "source", "split")
    SH.write_shards(c, path, ["doc_id"], shard_rows=100)
    return path


def write_shards(spark, sf):
    """Committed corpus shards of at most 100 rows per split, read back."""
    path = _shards(spark, sf, "shards")
    return SH.open_corpus(spark, path).select("id", "split", F.sha2("text", 256).alias("text"))


QUERIES["write_shards"] = write_shards
ORACLE["write_shards"] = f"WITH {CORPUS_SPLIT_SQL} SELECT id, split, sha256(text) AS text FROM corpus_split"


def corpus_manifest(spark, sf):
    """Manifest counts and fingerprint of the corpus."""
    m = IO.corpus_manifest(corpus_with_split(spark, sf))
    return m.select("format_version", "row_count",
                    F.col("split_counts")["train"].alias("train"),
                    F.coalesce(F.col("split_counts")["validation"], F.lit(0)).cast("bigint").alias("validation"),
                    F.size("source_counts").cast("bigint").alias("sources"), "fingerprint", "id_algorithm")


QUERIES["corpus_manifest"] = corpus_manifest
ORACLE["corpus_manifest"] = f"""
WITH {CORPUS_SPLIT_SQL},
h AS (SELECT sha256(id) AS h FROM corpus_split),
s AS (SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT) AS s1,
             sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT) AS s2 FROM h)
SELECT 2 AS format_version, rows AS row_count,
       (SELECT count(*) FROM corpus_split WHERE split = 'train') AS train,
       (SELECT count(*) FROM corpus_split WHERE split = 'validation') AS validation,
       (SELECT count(DISTINCT source) FROM corpus_split) AS sources,
       sha256(CAST(rows AS VARCHAR) || ':' || CAST(s1 % 18446744073709551616 AS VARCHAR) || ':'
              || CAST(s2 % 18446744073709551616 AS VARCHAR)) AS fingerprint,
       'sha256(source\\0text)' AS id_algorithm FROM s
"""


def validate_manifest(spark, sf):
    """A written manifest checked against shards that lost one language: every
    count that differs, and the fingerprint."""
    c = corpus_with_split(spark, sf)
    path = IO.scratch_path(spark, "manifest")
    IO.write_manifest(IO.corpus_manifest(c), path)
    m = spark.read.json(path)
    shards = _layout(spark, sf, "validate")
    reread = spark.read.parquet(shards).filter(F.col("config") != "de")
    total = c.count()
    return IO.validate_manifest(m, reread, total)


QUERIES["validate_manifest"] = validate_manifest
ORACLE["validate_manifest"] = f"""
WITH {CORPUS_SPLIT_SQL},
u AS (SELECT 'split_count:' || split AS k, lang, id FROM corpus_split
      UNION ALL SELECT 'source_count:' || source, lang, id FROM corpus_split),
n AS (SELECT k, count(*) AS e, nullif(count(*) FILTER (WHERE lang <> 'de'), 0) AS a FROM u GROUP BY k),
h AS (SELECT lang, sha256(id) AS h FROM corpus_split),
p AS (SELECT kept, sha256(CAST(count(*) AS VARCHAR) || ':'
          || CAST(sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS VARCHAR) || ':'
          || CAST(sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS VARCHAR)) AS f
      FROM (SELECT true AS kept, h FROM h WHERE lang <> 'de' UNION ALL SELECT false, h FROM h) GROUP BY kept)
SELECT k AS "check", CAST(e AS VARCHAR) AS expected, CAST(a AS VARCHAR) AS actual FROM n WHERE e IS DISTINCT FROM a
UNION ALL SELECT 'fingerprint', (SELECT f FROM p WHERE NOT kept), (SELECT f FROM p WHERE kept)
"""


def shard_list(spark, sf):
    """The shards that a committed corpus lists, with their rows."""
    return SH.shard_table(spark, _shards(spark, sf, "list")).select("split", "shard", "start", "stop", "rows")


QUERIES["shard_list"] = shard_list
ORACLE["shard_list"] = f"""
WITH {CORPUS_SPLIT_SQL},
p AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS k FROM corpus_split)
SELECT split, CAST(k // 100 AS INTEGER) AS shard, CAST(min(k) AS BIGINT) AS start, CAST(max(k) + 1 AS BIGINT) AS stop,
       count(*) AS rows FROM p GROUP BY split, k // 100
"""


def check_shards(spark, sf):
    """A committed corpus whose first train file is gone: the file, and the total."""
    path = _shards(spark, sf, "check")
    gone = SH.shard_table(spark, path).where("split = 'train' AND shard = 0").first()["file"]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
    return SH.check_corpus(spark, path)


QUERIES["check_shards"] = check_shards
ORACLE["check_shards"] = f"""
WITH {CORPUS_SPLIT_SQL},
n AS (SELECT count(*) AS n, least(100, count(*) FILTER (WHERE split = 'train')) AS first FROM corpus_split)
SELECT 'missing:train/0' AS "check", CAST(first AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM n
UNION ALL SELECT 'row_count', CAST(n AS VARCHAR), CAST(n - first AS VARCHAR) FROM n
"""


def corpus_build(spark, sf):
    """F2-F4 with A6-A9 in one call: the largest corpus in shares of 60, 20 and 20 that the
    sources allow, built, then opened again from its shards; rows per source and split."""
    docs = table(spark, sf, "documents")
    sizes = {r[0]: r[1] for r in prepare_corpus_rows(docs).groupBy("source").agg(F.count(F.lit(1))).collect()}
    first, second, *rest = sorted(sizes)
    total = min(sizes[first] * 10 // 6, sizes[second] * 5, sum(sizes[s] for s in rest) * 5)
    path = IO.scratch_path(spark, "build")
    SH.build_or_open_corpus(docs, path, total, shard_rows=100)
    rows, _ = SH.build_or_open_corpus(docs, path, total, shard_rows=100)
    return rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


QUERIES["corpus_build"] = corpus_build
ORACLE["corpus_build"] = f"""
WITH {CORPUS_SPLIT_SQL},
n AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS i FROM corpus_split GROUP BY source),
t AS (SELECT least(max(n * 10 // 6) FILTER (WHERE i = 1), max(n * 5) FILTER (WHERE i = 2), sum(n) FILTER (WHERE i > 2) * 5) AS t FROM n),
w AS (SELECT tier, t * w // 100 AS base, t * w % 100 AS rem, t FROM t, (VALUES (1, 60), (2, 20), (3, 20)) v(tier, w)),
q AS (SELECT tier, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, tier) <= any_value(t) OVER () - sum(base) OVER ()
                               THEN 1 ELSE 0 END AS q FROM w),
r AS (SELECT c.*, i, row_number() OVER (PARTITION BY c.source ORDER BY doc_id) AS k FROM corpus_split c JOIN n USING (source)),
s AS (SELECT *, row_number() OVER (PARTITION BY least(i, 3) ORDER BY CASE WHEN i > 2 THEN k ELSE 0 END,
                                   CASE WHEN i > 2 THEN i ELSE 0 END, k) AS place FROM r)
SELECT source, split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids
FROM s JOIN q ON q.tier = least(s.i, 3) WHERE place <= q GROUP BY source, split
"""


def resume_embedding(spark, sf):
    """E5 with H1: shards embedded, the same again (all found), then with a prompt (all anew)."""
    from weft.operators.embed import word_hash_encoder
    path, out = _shards(spark, sf, "embed"), IO.scratch_path(spark, "vectors")
    runs = []
    for step, prompt in (("first", ""), ("again", ""), ("prompt", "query: ")):
        vectors, done = SH.embed_corpus(spark, path, out, word_hash_encoder(32), 32, "word-hash", prompt)
        runs.append((step, done["computed"], done["skipped"], vectors.count()))
    return spark.createDataFrame(runs, "run string, computed long, skipped long, vectors long")


QUERIES["resume_embedding"] = resume_embedding
ORACLE["resume_embedding"] = f"""
WITH {CORPUS_SPLIT_SQL},
s AS (SELECT CAST(sum((n + 99) // 100) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM corpus_split GROUP BY split))
SELECT 'first' AS run, s AS computed, CAST(0 AS BIGINT) AS skipped, n AS vectors FROM s
UNION ALL SELECT 'again', 0, s, n FROM s UNION ALL SELECT 'prompt', s, 0, n FROM s
"""


def read_corpus(spark, sf):
    """The validation split of the layout, read with the declared schema."""
    path = _layout(spark, sf, "read")
    return IO.load_split(spark, path, CORPUS_FILE_SCHEMA, split="validation").select("doc_id", "id", "config")


QUERIES["read_corpus"] = read_corpus
ORACLE["read_corpus"] = f"""
WITH {CORPUS_SPLIT_SQL} SELECT doc_id, id, lang AS config FROM corpus_split WHERE split = 'validation'
"""


def discover_layout(spark, sf):
    """A10: (config, split) pairs of documents laid out as lang x source,
    restricted to the requested configs."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("config"), F.col("source").alias("split"))
    return IO.discover_layout(d, configs=["en", "fr"])


QUERIES["discover_layout"] = discover_layout
ORACLE["discover_layout"] = """
SELECT DISTINCT lang AS config, source AS split FROM documents WHERE lang IN ('en', 'fr')
"""


def save_config(spark, sf):
    """Rewrite one config (fr, upper-cased text); the others stay."""
    path = IO.scratch_path(spark, "configs")
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("config"),
                                             F.col("source").alias("split"))
    IO.write_layout(d, path)
    IO.save_config(d.filter(F.col("config") == "fr").withColumn("text", F.upper("text")), path)
    IO.save_config(d.filter(F.col("config") == "de").withColumn("text", F.lit("skipped")), path,
                   skip_existing=True)
    out = spark.read.parquet(path)
    return out.select("doc_id", "config", F.sha2("text", 256).alias("text"))


QUERIES["save_config"] = save_config
ORACLE["save_config"] = """
SELECT doc_id, lang AS config, sha256(CASE WHEN lang = 'fr' THEN upper(text) ELSE text END) AS text FROM documents
"""


def write_metrics_csv(spark, sf):
    """A metrics table written as CSV with a header and read back."""
    path = IO.scratch_path(spark, "csv")
    IO.write_metrics_csv(share_by_group(table(spark, sf, "documents"), ["lang"]), path)
    return spark.read.schema("lang string, n bigint, pct double").option("header", True).csv(path)


QUERIES["write_metrics_csv"] = write_metrics_csv
ORACLE["write_metrics_csv"] = """
SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY lang
"""


def _stream_source(spark, sf):
    src = IO.scratch_path(spark, "stream-src")
    # some files, so that the stream has several batches; a real source brings its own
    docs = table(spark, sf, "documents")
    docs.repartition(max(4, docs.rdd.getNumPartitions()), "doc_id").write.parquet(src)
    return src


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stream_corpus(spark, sf):
    """M1: documents arriving as files -> clean, id, streaming exact dedup,
    split -> Parquet sink; counts per (source, split) equal the batch path."""
    src = _stream_source(spark, sf)
    out = ST.run_available(spark, src, DOC_SCHEMA, ST.corpus_stream, IO.scratch_path(spark, "stream-out"),
                           IO.scratch_path(spark, "stream-ckpt"), max_files_per_trigger=1)
    return out.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES["stream_corpus"] = stream_corpus
ORACLE["stream_corpus"] = f"""
WITH {CORPUS_SPLIT_SQL} SELECT source, split, count(*) AS n FROM corpus_split GROUP BY 1, 2
"""


def stream_hash_split(spark, sf):
    """M2: stateless 2 % text-hash hold-out of a stream."""
    src = _stream_source(spark, sf)
    out = ST.run_available(spark, src, DOC_SCHEMA, ST.split_stream, IO.scratch_path(spark, "split-out"),
                           IO.scratch_path(spark, "split-ckpt"))
    return out.select("doc_id", "split")


QUERIES["stream_hash_split"] = stream_hash_split
ORACLE["stream_hash_split"] = f"""
SELECT doc_id, CASE WHEN {S.hex_mod100(f"sha256({S.clean('text')})")} < 2 THEN 'eval' ELSE 'train' END AS split
FROM documents WHERE {S.clean('text')} <> ''
"""
