"""Streams with keyed state and timers against the batch folds on the same rows."""

import pytest
from docloom.operators import extensions, monitoring, politeness
from docloom.streaming import keyed
from pyspark.sql import functions as F

SCHEMA = "k string, s double, status_code int, after double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rows = [("a", 7.25 * i + (i % 3) / 4, [200, 404, 429, 503, 500][i * i % 5], [None, 9.0][i % 2]) for i in range(60)]
    rows += [("b", 100.0 * i, [200, 503][i % 2], None) for i in range(4)] + [("z", 50_000.0, 200, None), (None, 3.5, 503, None)]
    path = str(tmp_path_factory.mktemp("keyed") / "rows")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6 + 86400e6).cast("long")))
    for part, (low, high) in enumerate(((-1, 100), (100, 101), (101, 300), (300, 1e9))):  # files are read in order of time
        df.filter((F.col("s") > low) & (F.col("s") <= high)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def drained(spark, path, schema, make, mode, tmp_path, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return spark.table(name), states


@pytest.fixture(autouse=True, scope="module")
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bucket(spark, source, tmp_path):
    path, rows = source
    out, states = drained(spark, path, rows.schema, lambda s: keyed.token_bucket(s, "k", rate=0.05, capacity=3.0), "append", tmp_path, "bucket")
    got = {r.k: (r.n, r.w) for r in out.groupBy("k").agg(F.count_if("granted").alias("n"), F.sum("waited").alias("w")).collect()}
    want = {r.k: (r.granted, pytest.approx(r.waited)) for r in politeness.token_bucket(rows, "k", "s", ["s"], 0.05, 3.0).collect()}
    assert got == want and out.count() == rows.count()


def test_backoff(spark, source, tmp_path):
    path, rows = source
    out, _ = drained(spark, path, rows.schema, lambda s: keyed.error_backoff(s, "k", retry_after="after", idle=1e6), "update", tmp_path, "backoff")
    want = {r.k: (r.errors, r.backoff, r.throttled) for r in extensions.error_backoff(rows, "k", ["s"], retry_after="after").collect()}
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append((r.errors, r.backoff, r.throttled))
    assert {k: want[k] in v for k, v in got.items()} == dict.fromkeys(want, True)


def test_cooldown_and_state_expires(spark, source, tmp_path):
    path, rows = source
    out, states = drained(spark, path, rows.schema, lambda s: keyed.cooldown(s, "k", hold=33.3, late="1 second"), "append", tmp_path, "cool")
    want = {(r.k, r.sent_at) for r in monitoring.cooldown(rows, "k", hold=33.3).collect()}
    got = [(r.k, r.sent_at) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    removed = sum(s["numRowsRemoved"] for s in states)
    assert removed > 0  # the timers of a and b, once z has moved the watermark
