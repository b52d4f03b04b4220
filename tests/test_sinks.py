"""Keyed sinks of streams: a repeated or broken micro-batch changes nothing."""

import pytest
from docloom.operators import tables
from docloom.streaming import sinks
from pyspark.sql import functions as F

SCHEMA = "k string, day long, n long"


@pytest.fixture(scope="module")
def batches(spark):
    rows = [(f"k{(i * 7) % 11}" if i % 13 else None, i // 4, i) for i in range(120)]
    return [spark.createDataFrame(rows[at : at + 40], SCHEMA) for at in (0, 40, 80)]


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_and_replay(spark, batches, tmp_path):
    sink = sinks.KeyedSink(spark, str(tmp_path / "s"), SCHEMA, "k", buckets=4)
    put = sink.upsert("n")
    for i, b in enumerate(batches):
        put(b, i)
        before = as_set(sink.rows())
        put(b.withColumn("n", F.col("n") + 1000), i)  # a batch that the ledger has
        assert as_set(sink.rows()) == before
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = as_set(tables.upsert(whole.limit(0), whole, ["k"], "n"))
    assert as_set(sink.rows()) == want
    sink.vacuum()
    assert as_set(sink.rows()) == want


def test_a_batch_that_breaks_before_the_ledger(spark, batches, tmp_path, monkeypatch):
    sink = sinks.KeyedSink(spark, str(tmp_path / "s"), SCHEMA, "k", buckets=4)
    put = sink.upsert("n")
    put(batches[0], 0)
    before = as_set(sink.rows())
    with monkeypatch.context() as m:
        m.setattr(sink, "_append_ledger", lambda lines: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            put(batches[1], 1)
    assert as_set(sink.rows()) == before
    put(batches[1], 1)
    assert as_set(sink.rows()) != before and sink.rows().count() == sink.rows().select("k").distinct().count()


def test_unseen_is_the_batch_fold(spark, batches, tmp_path, monkeypatch):
    sink = sinks.KeyedSink(spark, str(tmp_path / "s"), "k string, last long", "k", buckets=3)
    take = sink.take_unseen(str(tmp_path / "taken"), "day", "n", 9)
    for i, b in enumerate(batches):
        if i == 1:  # broken between the rows and the ledger, then repeated
            with monkeypatch.context() as m:
                m.setattr(sink, "_append_ledger", lambda lines: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    take(b, i)
        take(b, i)
        take(b, i)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    got = spark.read.parquet(str(tmp_path / "taken")).select("k", "day", "n")
    assert as_set(got) == as_set(tables.sink_unseen(whole, "k", "day", "n", 9).select("k", "day", "n"))


def test_stream_into_a_sink(spark, batches, tmp_path):
    source = str(tmp_path / "in")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
    sink = sinks.KeyedSink(spark, str(tmp_path / "s"), SCHEMA, "k")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # a second query without a checkpoint numbers the batches from 0 again
        q = stream.writeStream.foreachBatch(sink.upsert("n")).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination(200)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert as_set(sink.rows()) == as_set(tables.upsert(whole.limit(0), whole, ["k"], "n"))
    assert sorted(r.batch for r in sink.ledger().select("batch").distinct().collect()) == [0, 1, 2]
