"""Loaders and the sink as Spark data sources: partitions, retries, types, failed jobs."""

import os

import pytest
from pyspark.sql import functions as F

from weft.sources.loader import NdjsonLoader, register_loader, register_sink, resumed


def numbers(broken=None, path=None):
    """A loader that travels by value: workers cannot import this module."""
    class Numbers:
        def __init__(self, broken=None, path=None):
            self.broken, self.path = broken, path

        def shards(self, options):
            return list(range(int(options["n"])))

        def rows(self, options, shard):
            for k in range(10):
                mark = f"{self.path}/{shard}" if self.path else None
                if shard == self.broken and k == 6 and not (mark and os.path.exists(mark)):
                    if mark:
                        open(mark, "w").close()
                    raise OSError("connection lost")
                yield {"id": 100 * shard + k, "text": f"row {k}", "more": "unused"}

    return Numbers(broken, path)


def test_one_partition_per_shard(spark):
    register_loader(spark, "numbers", numbers(), "id long, text string, lang string")
    df = spark.read.format("numbers").option("n", 5).load()
    assert df.rdd.getNumPartitions() == 5
    got = df.withColumn("p", F.spark_partition_id()).collect()
    assert {(r.id, r.text, r.lang, r.p) for r in got} == {(100 * s + k, f"row {k}", None, s) for s in range(5) for k in range(10)}
    assert spark.read.format("numbers").option("n", 0).load().collect() == []
    assert df.where("id >= 400").select("text").count() == 10


def test_a_shard_that_fails_is_read_on(spark, tmp_path):
    register_loader(spark, "flaky", numbers(2, str(tmp_path)), "id long, text string")
    got = [r.id for r in spark.read.format("flaky").option("n", 4).option("wait", "0.01").load().collect()]
    assert sorted(got) == [100 * s + k for s in range(4) for k in range(10)] and os.listdir(tmp_path) == ["2"]
    register_loader(spark, "broken", numbers(1), "id long, text string")
    with pytest.raises(Exception, match="connection lost"):
        spark.read.format("broken").option("n", 2).option("retries", "1").option("wait", "0.01").load().collect()


def test_values_of_another_type_raise(spark):
    register_loader(spark, "typed", numbers(), "id string, text string")
    with pytest.raises(Exception, match="id is int, not string"):
        spark.read.format("typed").option("n", 1).load().collect()


def test_resumed_skips_what_was_handed_on():
    calls = []

    def make():
        calls.append(1)
        for k in range(7):
            if len(calls) < 4 and k == 2 * len(calls):
                raise OSError
            yield k

    assert list(resumed(make, 1, 0)) == list(range(7)) and len(calls) == 4


def test_sink_and_loader_round_trip(spark, tmp_path):
    register_sink(spark)
    register_loader(spark, "ndjson_loader", NdjsonLoader(), "id long, text string")
    path = str(tmp_path / "out")
    rows = [(i, None if i % 9 == 0 else f"line {i}\n日本 \"x\"") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    df.write.format("ndjson_sink").mode("append").save(path)
    back = spark.read.format("ndjson_loader").option("path", path).load()
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == rows
    bad = df.withColumn("text", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("ndjson_sink").mode("append").save(path)
    assert sorted(map(tuple, spark.read.format("ndjson_loader").option("path", path).load().collect())) == rows
    assert not [f for f in os.listdir(path) if f.startswith("_")]
