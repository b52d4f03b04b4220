"""Ordered folds in chunks against plain Python folds, with keys of very different sizes."""

import random

import pytest
from docloom.operators import extensions, monitoring, politeness, tables

SCHEMA = "k string, i long, t double, code int, v double, after double, ok boolean"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for key, n in (("hot", 900), ("b", 40), ("c", 1), (None, 30)):
        t = 0.0
        for i in range(n):
            t += r.choice([0, 0.5, 1, 3, 20, 90]) if i % 100 < 90 else 400
            code = r.choice([200, 200, 301, 404, 429, 500, 503]) if i % 60 < 45 else 503
            out.append((key, i, t, code, r.uniform(0, 9), r.choice([None, None, 7.0]), r.random() < 0.55))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    return spark.createDataFrame(shuffled, SCHEMA).repartition(6)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [5, 64, 100_000])
def test_average(df, rows, size):
    got = {r.k: r.ema for r in politeness.ema(df, "k", "v", ["i"], size=size).collect()}
    want = {}
    for k, xs in by_key(rows).items():
        a = xs[0][4]
        for x in xs[1:]:
            a = 0.9 * a + 0.1 * x[4]
        want[k] = a
    assert got == pytest.approx(want)


@pytest.mark.parametrize("size", [5, 64, 100_000])
def test_bucket(df, rows, size):
    got = {r.k: (r.granted, r.waited, r.tokens) for r in politeness.token_bucket(df, "k", "t", ["t", "i"], 0.25, 3.0, size=size).collect()}
    for k, xs in by_key(rows).items():
        tokens, last, granted, waited = 3.0, None, 0, 0.0
        for x in xs:
            tokens = min(3.0, tokens + (x[2] - last if last is not None else 0) * 0.25)
            last = x[2]
            if tokens >= 1:
                tokens, granted = tokens - 1, granted + 1
            else:
                waited += (1 - tokens) / 0.25
        assert got[k] == pytest.approx((granted, waited, tokens))


@pytest.mark.parametrize("size", [5, 64, 100_000])
def test_throttle(df, rows, size):
    got = {r.k: (r.state, r.errors, r.backoff, r.rate) for r in politeness.throttle(df, "k", ["i"], "code", size=size).collect()}
    for k, xs in by_key(rows).items():
        n, rate = 0, 1.0
        for x in xs:
            n = n + 1 if x[3] >= 400 else 0
            rate = max(0.1, min(10.0, rate * (0.5 if x[3] in (429, 503) else 0.9 if x[3] >= 400 else 1.1)))
        state = "blocked" if n >= 10 else "backoff" if n >= 3 else "normal"
        assert got[k][:2] == (state, n)
        assert got[k][2:] == pytest.approx((min(300.0, 2.0 ** (n - 3)) if n >= 10 else min(60.0, 2.0**n) if n >= 3 else 0.0, rate))


@pytest.mark.parametrize("size", [5, 100_000])
@pytest.mark.parametrize("after", [None, "after"])
def test_error_backoff(df, rows, size, after):
    got = {r.k: (r.errors, r.backoff, r.throttled) for r in extensions.error_backoff(df, "k", ["i"], "code", after, size=size).collect()}
    for k, xs in by_key(rows).items():
        n, wait = 0, 0.0
        for x in xs:
            limited = x[3] in (429, 503)
            n = n + 1 if limited or x[3] >= 500 else 0 if x[3] < 400 else n
            if limited:
                wait = x[5] if after and x[5] is not None else min(300.0, 2.0**n)
            elif x[3] < 400:
                wait = 0.0
        assert got[k] == (n, wait, 60.0 if n >= 3 else 0.0)


@pytest.mark.parametrize("size", [1, 5, 100_000])
def test_health(df, rows, size):
    got = {r.k: (r.health, r.fails, r.banned) for r in tables.health(df, "k", ["i"], "ok", 4, size=size).collect()}
    for k, xs in by_key(rows).items():
        level, n, banned = 1.0, 0, False
        for x in xs:
            n = 0 if x[6] else n + 1
            level = min(1.0, level + 0.1) if x[6] else max(0.0, level - 0.2)
            banned |= n >= 4
        assert got[k] == (pytest.approx(level, abs=1e-9), n, banned)


@pytest.mark.parametrize("size", [3, 40, 1000])
def test_cooldown(spark, df, rows, size):
    at = df.selectExpr("k", "timestamp_micros(CAST(t * 1000000 AS LONG)) AS ts")
    got = sorted((str(r.k), r.s) for r in monitoring.cooldown(at, "k", hold=33.5, size=size).selectExpr("k", "unix_micros(sent_at) AS s").collect())
    want = []
    for k, xs in by_key(rows).items():
        last = None
        for t in sorted({x[2] for x in xs}):
            if last is None or t - last >= 33.5:
                last = t
                want.append((str(k), round(t * 1e6)))
    assert got == sorted(want)


def test_one_key_lies_in_many_chunks_and_partitions(spark, df):
    from docloom.operators import scan
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions worth keeping
    cut = scan.chunks(df, "k", ["i"], {"i": F.col("i")}, size=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = cut.filter("key = 'hot'")
    assert hot.select("part").distinct().count() >= 2 and hot.count() >= 18
    assert cut.agg(F.max(F.size("xs"))).first()[0] <= 50
    xs = [x.i for r in hot.orderBy("chunk").collect() for x in r.xs]
    assert xs == sorted(xs) and len(xs) == 900


def test_empty(df):
    none = df.limit(0)
    assert politeness.throttle(none, "k", ["i"], "code").count() == 0
    assert politeness.token_bucket(none, "k", "t", ["i"], 1, 2).count() == 0
    assert tables.health(none, "k", ["i"], "ok").count() == 0


@pytest.mark.parametrize("hold", [0, 7, 30_000])
def test_cooldown_of_many_times_within_hold(spark, hold):
    """All alerts of a stretch may be the first one sent, so what it does has as many pieces as rows."""
    n = 60_000
    at = spark.range(n).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' WHEN id % 1000 = 1 THEN NULL ELSE 'a' END AS k", "timestamp_seconds(id) AS ts")
    at = at.union(at.limit(100))
    want = set()
    for key, of in (("b", lambda i: i % 10 == 0), (None, lambda i: i % 1000 == 1), ("a", lambda i: i % 10 and i % 1000 != 1)):
        last = None
        for t in filter(of, range(n)):
            if last is None or t - last >= hold:
                last = t
                want.add((key, t))
    for size in (100, monitoring.RUN):
        got = monitoring.cooldown(at, "k", hold=hold, size=size).selectExpr("k", "unix_seconds(sent_at) AS s").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
