"""Committed shards, the corpus build in one call, and embeddings that can be resumed."""

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.sources import shards as S
from weft.sources.files import DataError


def docs(spark, n=400):
    rows = [(i, f"text {i % 350}", "en", f"src{min(i % 10, 4)}") for i in range(n)] + [(9000, "  ", "en", "src0"), (9001, None, "en", "src1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def corpus(spark, n=95):
    rows = [(f"id{i:03}", f"t{i}", "a" if i % 3 else "b", "train" if i % 5 else "validation", i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, text string, source string, split string, at long").repartition(4)


def test_shards_are_whole_ordered_and_listed(spark, tmp_path):
    path = str(tmp_path / "c")
    marker = S.write_shards(corpus(spark), path, ["at"], shard_rows=10)
    assert (marker["row_count"], marker["split_counts"], marker["source_counts"]) == (95, {"train": 76, "validation": 19}, {"a": 63, "b": 32})
    table = S.shard_table(spark, path).collect()
    assert [(r.split, r.shard, r.start, r.stop, r.rows) for r in table] == [
        ("train", k, 10 * k, min(10 * k + 10, 76), min(10, 76 - 10 * k)) for k in range(8)] + [("validation", 0, 0, 10, 10), ("validation", 1, 10, 19, 9)]
    assert len({r.file for r in table}) == len(table)
    got = S.open_corpus(spark, path)
    want = {r.id: (r.split, r.at) for r in corpus(spark).collect()}
    assert {r.id: (r.split, r.at) for r in got.collect()} == want
    for s in ("train", "validation"):
        order = sorted(at for x, at in want.values() if x == s)
        assert all(order.index(r.at) // 10 == r.shard for r in got.where(F.col("split") == s).collect())
    assert S.check_corpus(spark, path, deep=True).collect() == []
    with pytest.raises(DataError, match="already"):
        S.write_shards(corpus(spark), path, ["at"])


def test_a_killed_write_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "c")
    bad = corpus(spark).withColumn("text", F.when(F.col("at") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        S.write_shards(bad, path, ["at"], shard_rows=10)
    assert S.open_or_none(spark, path) is None
    # shards without a marker: the job died before the commit
    S.write_shards(corpus(spark), path, ["at"], shard_rows=10)
    os.remove(os.path.join(path, S.MARKER))
    for call in (lambda: S.open_or_none(spark, path), lambda: S.open_corpus(spark, path), lambda: S.write_shards(corpus(spark), path, ["at"])):
        with pytest.raises(DataError, match="incomplete"):
            call()


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "c")
    S.write_shards(corpus(spark), path, ["at"], shard_rows=10)
    base = glob.glob(f"{path}/build-*/rows")[0]
    first, second = (glob.glob(f"{base}/split=train/shard={k}/*.parquet")[0] for k in (0, 1))
    os.remove(first)
    shutil.copy(second, os.path.join(os.path.dirname(second), "more.parquet"))
    last = glob.glob(f"{base}/split=validation/shard=1/*.parquet")[0]
    half = spark.read.parquet(last).limit(4).toPandas()
    half.to_parquet(last)
    crc = os.path.join(os.path.dirname(last), "." + os.path.basename(last) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    got = {(r.check, r.expected, r.actual) for r in S.check_corpus(spark, path).collect()}
    assert got == {("missing:train/0", "10", None), ("unlisted:train/1", None, "10"), ("rows:validation/1", "9", "4"),
                   ("row_count", "95", "90")}
    assert "fingerprint" in {r.check for r in S.check_corpus(spark, path, deep=True).collect()}


def test_corpus_in_one_call(spark, tmp_path):
    path = str(tmp_path / "c")
    rows, marker = S.build_or_open_corpus(docs(spark), path, 50, shard_rows=7)
    assert marker["source_counts"] == {"src0": 30, "src1": 10, "src2": 4, "src3": 3, "src4": 3}
    first = {r.id: r.source for r in rows.collect()}
    assert len(first) == 50
    assert max(r.rows for r in S.shard_table(spark, path).collect()) <= 7
    again, same = S.build_or_open_corpus(docs(spark), path, 50, shard_rows=7)
    assert same == marker and {r.id: r.source for r in again.collect()} == first
    with pytest.raises(DataError, match="built with"):
        S.build_or_open_corpus(docs(spark), path, 60, shard_rows=7)
    os.remove(glob.glob(f"{path}/build-*/rows/split=train/shard=0/*.parquet")[0])
    with pytest.raises(DataError, match="damaged"):
        S.build_or_open_corpus(docs(spark), path, 50, shard_rows=7)
    with pytest.raises(ValueError, match="src0"):
        S.build_or_open_corpus(docs(spark), str(tmp_path / "d"), 300)
    assert S.open_or_none(spark, str(tmp_path / "d")) is None


def encoder(log, fail_on=None):
    def factory():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            if fail_on in texts:
                raise RuntimeError("lost executor")
            return np.array([[len(t), sum(map(ord, t)) % 97] for t in texts], np.float32)
        return encode
    return factory


def seen(log):
    return sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    path, out, log = str(tmp_path / "c"), str(tmp_path / "v"), str(tmp_path / "log")
    S.write_shards(corpus(spark), path, ["at"], shard_rows=10)
    texts = sorted(f"p: t{i}" for i in range(95))
    last = S.open_corpus(spark, path).where("split = 'validation' AND shard = 1").first().text
    with pytest.raises(Exception, match="lost executor"):
        S.embed_corpus(spark, path, out, encoder(log, f"p: {last}"), 2, "m", "p: ", wave=4)
    before = len(seen(log))
    os.remove(log)
    vectors, done = S.embed_corpus(spark, path, out, encoder(log), 2, "m", "p: ", wave=4)
    assert (done["skipped"], done["computed"]) == (8, 2) and before >= 76
    assert len(seen(log)) == 19
    got = {r.id: list(r.embedding) for r in vectors.collect()}
    assert got == {f"id{i:03}": [len(t), sum(map(ord, t)) % 97] for i in range(95) for t in [f"p: t{i}"]}
    # the same again computes nothing, another prompt everything
    os.remove(log)
    vectors, done = S.embed_corpus(spark, path, out, encoder(log), 2, "m", "p: ")
    assert (done["skipped"], done["computed"], seen(log), vectors.count()) == (10, 0, [], 95)
    vectors, done = S.embed_corpus(spark, path, out, encoder(log), 2, "m", "q: ")
    assert (done["skipped"], done["computed"], len(seen(log)), vectors.count()) == (0, 10, 95, 95)
    with pytest.raises(Exception, match="shape"):
        S.embed_corpus(spark, path, out, encoder(log), 3, "m", "q: ")
    assert texts


def test_small_shards_share_tasks_and_a_wave_takes_few_jobs(spark, tmp_path):
    path, sc = str(tmp_path / "c"), spark.sparkContext
    rows = spark.range(1200).select(F.format_string("id%04d", "id").alias("id"), F.col("id").alias("at"), F.lit("t").alias("text"),
                                    F.lit("train").alias("split"), F.lit("a").alias("source"))
    S.write_shards(rows, path, ["at"], shard_rows=2)
    jobs = {}
    for wave in (100, 600):
        sc.setJobGroup(f"wave {wave}", "")
        try:
            vectors, done = S.embed_corpus(spark, path, str(tmp_path / str(wave)), encoder(str(tmp_path / "log")), 2, "m", wave=wave)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert done["computed"] == 600 and vectors.count() == vectors.select("split", "shard", "id").distinct().count() == 1200
        status = sc.statusTracker()
        jobs[wave] = len(status.getJobIdsForGroup(f"wave {wave}"))
    files = glob.glob(f"{tmp_path}/100/*/wave*/*/*/*.parquet")
    assert len(files) == 600  # one a shard; its task's number follows "part-"
    tasks = {(f.split("/wave")[1].split("/")[0], os.path.basename(f)[:10]) for f in files}
    assert len(tasks) <= 6 * min(100, 3 * sc.defaultParallelism)
    assert (jobs[100] - jobs[600]) / 5 < 9
