"""Streams against the batch operators on the same rows."""

import pytest
from docloom.operators import monitoring, politeness
from docloom.plans import base
from docloom.streaming import streams
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def source(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "crawl")
    rows = base.derived(spark, sf, base.CRAWL).withColumn("ts", F.col("ts").cast("timestamp")).filter("event_id < 300")
    rows.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return path, spark.read.parquet(path)


def drained(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windowed_counters(spark, source, tmp_path):
    path, rows = source
    s = streams.windowed_counters(streams.results(spark, path, rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")))
    got = drained(spark, s, "counters", "complete", tmp_path)
    assert got.agg(F.sum("requests")).first()[0] == rows.count()


def test_cooldown_is_the_batch_fold(spark, source, tmp_path):
    path, rows = source
    stream = spark.readStream.schema(rows.schema).parquet(path).filter("NOT success")
    got = {(r.crawl_id, int(r.sent_at)) for r in drained(spark, streams.cooldown(stream, seconds=3600), "cool", "append", tmp_path).collect()}
    want = {(r.crawl_id, r.sent_at) for r in monitoring.cooldown(rows.filter("NOT success"), "crawl_id", hold=3600).collect()}
    # the stream compares fractions of seconds, the batch whole ones
    assert {k for k, _ in got} == {k for k, _ in want} and abs(len(got) - len(want)) <= 2


def test_throttle_state(spark, source, tmp_path):
    path, rows = source
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = {r.crawl_id: r for r in drained(spark, streams.throttle(stream, "crawl_id"), "throttled", "update", tmp_path).collect()}
    want = {r.crawl_id: r for r in politeness.throttle(rows, "crawl_id", ["event_id"]).collect()}
    assert {k: (r.errors, round(r.rate, 6)) for k, r in got.items()} == {k: (r.errors, round(r.rate, 6)) for k, r in want.items()}


def test_first_seen(spark, source, tmp_path):
    path, rows = source
    got = drained(spark, streams.first_seen(spark.readStream.schema(rows.schema).parquet(path), "url", ttl="60 days"), "seen", "append", tmp_path)
    assert got.count() == rows.select("url").distinct().count()
