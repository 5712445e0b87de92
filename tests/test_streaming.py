"""Streaming corpus: null sources, restarts from the checkpoint, state on disk and its size."""

import pytest

SCHEMA = "doc_id long, text string, source string, ts timestamp"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture()
def paths(tmp_path):
    return [str(tmp_path / x) for x in ("src", "out", "ckpt")]


def test_null_sources_keep_their_rows(spark, paths):
    from weft.operators.corpus import prepare_corpus_rows
    from weft.streaming.corpus import corpus_stream, run_available
    src, out, ckpt = paths
    rows = [(1, "a", None, None), (2, "b", None, None), (3, "c", None, None), (4, "c", "x", None), (5, "c", None, None)]
    write(spark, src, rows)
    got = run_available(spark, src, SCHEMA, corpus_stream, out, ckpt)
    batch = prepare_corpus_rows(spark.createDataFrame(rows, SCHEMA))
    assert {(r.id, r.source) for r in got.collect()} == {(r.id, r.source) for r in batch.collect()}
    assert got.count() == 4


def test_restart_from_the_checkpoint_stays_exact(spark, paths):
    from weft.streaming.corpus import ROCKSDB, corpus_stream, run_available
    src, out, ckpt = paths
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    write(spark, src, [(i, f"text {i % 40}", "s", None) for i in range(100)])
    first = []
    assert run_available(spark, src, SCHEMA, corpus_stream, out, ckpt, progress=first).count() == 40
    assert first[-1][2] == 40
    # the same texts again and some new ones: only those are new, also for the state
    write(spark, src, [(200 + i, f"text {i}", "s", None) for i in range(60)])
    second = []
    got = run_available(spark, src, SCHEMA, corpus_stream, out, ckpt, progress=second)
    assert got.count() == 60 == got.select("id").distinct().count()
    assert sum(p[1] for p in second) == 60 and second[-1][2] == 60
    # nothing new: nothing is read or written
    third = []
    assert run_available(spark, src, SCHEMA, corpus_stream, out, ckpt, progress=third).count() == 60
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before != ROCKSDB


def test_state_is_forgotten_behind_the_watermark(spark, paths):
    import datetime as dt

    from weft.streaming.corpus import corpus_stream, run_available
    src, out, ckpt = paths
    day = dt.datetime(2024, 1, 1)
    sizes = []
    for k in range(3):
        write(spark, src, [(100 * k + i, f"text {k} {i}", "s", day + dt.timedelta(days=3 * k)) for i in range(20)] * 2)
        run_available(spark, src, SCHEMA, lambda s: corpus_stream(s, within=("ts", "1 day")), out, ckpt, progress=sizes)
    assert spark.read.parquet(out).count() == 60
    assert max(p[2] for p in sizes) <= 40 < 60
