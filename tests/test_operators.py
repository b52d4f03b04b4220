"""Operators against literals, independent restatements and invariants."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators import crawl, dedup, html, inference, monitoring, politeness, records, tables, trees, vector_index
from docloom.sources import io
from pyspark.sql import functions as F


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True))).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        ("http://a.b/c/d?q#f", "x", "http://a.b/c/x"), ("http://a.b/c/d", "../x", "http://a.b/x"), ("http://a.b", "x", "http://a.b/x"), ("https://a.b/c/", "//h/x", "https://h/x"),
        ("http://a.b/c/d", "/x/./y/../z?q", "http://a.b/x/z?q"), ("http://a.b/c?x=1", "?y=2", "http://a.b/c?y=2"), ("http://a.b/c#f", "#g", "http://a.b/c#g"), ("http://a.b/c", "mailto:x@y", "mailto:x@y"), ("http://a.b/c", "", "http://a.b/c"),
    ],
)
def test_resolve(spark, base, link, want):
    assert one(spark, U.resolve, base, link) == want


def test_urls(spark):
    assert one(spark, U.canonical, " HTTP://A.b/C?b=2&a=1#F ") == "http://a.b/c?a=1&b=2"
    assert one(spark, lambda c: U.canonical(c, keep_fragment_with_query=True), "http://a.b/?b&a#f") == "http://a.b/?a&b#f"
    assert one(spark, U.host, "http://user:pw@A.b:80/x") == "a.b"
    assert one(spark, U.country, "http://a.co.uk:80/x") is None  # the port is part of the last label
    assert one(spark, U.country, "http://a.co.uk/x") == "United Kingdom"


def test_text(spark):
    assert one(spark, T.clean, "  a\t\tb\r\nc ") == "a b c"
    assert one(spark, T.clean_spaces, "a\t\tb\r\nc ") == "a bc "
    assert one(spark, lambda c: T.pad(c, 2), "abc") == "abc"
    assert [one(spark, lambda c, w=w: T.pad(c, w, "*", "both"), s) for s, w in (("ab", 5), ("abc", 6))] == ["ab".center(5, "*"), "abc".center(6, "*")]
    assert one(spark, lambda c: T.zero_fill(c, 5), "-42") == "-42".zfill(5)
    assert one(spark, T.text_hash, "") == "" and one(spark, T.text_hash, " a  b ") == one(spark, T.text_hash, "a b")
    assert one(spark, lambda c: T.shingles(T.tokens(c)), "one two") == []
    assert one(spark, T.looks_dynamic, "bcdfghjk") and not one(spark, T.looks_dynamic, "main-content")


def brute_first_seen(fps, radius):
    kept, out = [], {}
    for k in sorted(fps):
        near = [j for j in kept if (fps[k] ^ fps[j]).bit_count() <= radius]
        out[k] = near[0] if near else None
        if not near:
            kept.append(k)
    return out


def test_near_pairs_and_first_seen(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(5)]
    fps = {}
    for i in range(60):
        x = rnd.choice(base)
        for _ in range(rnd.randrange(8)):
            x ^= 1 << rnd.randrange(64)
        fps[i] = x
    fps = {k: x for k, x in fps.items() if k == min(j for j, y in fps.items() if y == x)}
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in fps.items()], "k long, fp long")
    for sim, radius in ((0.85, 9), (0.95, 3)):
        pairs = dedup.near_pairs(df, "k", sim)
        want = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius}
        rows = pairs.collect()
        assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
        got = {r.k: r.duplicate_of for r in dedup.first_seen(pairs, df.select("k")).collect()}
        assert got == brute_first_seen(fps, radius)


def test_chain_keeps_first_and_last(spark):
    df = spark.createDataFrame([(1, 0), (2, 0b11), (3, 0b1111)], "k long, fp long")
    got = {r.k: r.duplicate_of for r in dedup.first_seen(dedup.near_pairs(df, "k", 1 - 2 / 64), df.select("k")).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_ladders(spark):
    grades = [one(spark, records.grade, x) for x in (1.0, 0.9, 0.89, 0.8, 0.7, 0.6, 0.59)]
    assert grades == list("AABBCDF")
    assert [one(spark, records.level, x) for x in (0.9, 0.7, 0.5, 0.3, 0.29)] == ["excellent", "good", "acceptable", "poor", "invalid"]
    now = datetime(2024, 2, 1)
    ages = [one(spark, records.timeliness, datetime(2024, 1, 31), now), one(spark, records.timeliness, datetime(2024, 1, 25), now), one(spark, records.timeliness, datetime(2024, 1, 2), now), one(spark, records.timeliness, datetime(2023, 2, 1), now), one(spark, records.timeliness, datetime(2023, 1, 1), now), one(spark, records.timeliness, datetime(2025, 1, 1), now)]
    assert ages == [1.0, 0.9, 0.7, 0.5, 0.3, 1.0]
    assert records.consistency_groups(["price", "price2", "user_id", "user_key"], {"price": "double", "price2": "double", "user_id": "int", "user_key": "string"}) == 0.5


def test_ring_moves_only_the_removed_nodes_keys(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(8)], "node_id string")
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    before = {r.k: r.node for r in crawl.route(keys, "k", crawl.ring(nodes, "node_id")).collect()}
    after = {r.k: r.node for r in crawl.route(keys, "k", crawl.ring(nodes.filter("node_id <> 'n3'"), "node_id")).collect()}
    assert len(before) == 500 and {k for k in before if before[k] != after[k]} == {k for k, n in before.items() if n == "n3"}


def test_throttle_is_its_restatement(spark):
    rnd = random.Random(3)
    codes = [rnd.choice([200, 200, 503, 404, 500]) for _ in range(40)] + [500] * 12
    got = politeness.throttle(spark.createDataFrame([("d", i, c) for i, c in enumerate(codes)], "domain string, i int, status_code int"), "domain", ["i"]).first()
    errors, rate = 0, 1.0
    for c in codes:
        errors = errors + 1 if c >= 400 else 0
        rate = max(0.1, min(10.0, rate * (0.5 if c in (429, 503) else 0.9 if c >= 400 else 1.1)))
    assert (got.state, got.errors) == ("blocked", errors) and abs(got.rate - rate) < 1e-9 and got.backoff == min(300.0, 2.0 ** (errors - 3))


def test_robots(spark):
    text = "User-agent: a\nUser-agent: *\nAllow: /x/y\nDisallow: /x\nDisallow: /*.pdf$\nRequest-rate: 1/0\nCrawl-delay: bad"
    r = politeness.robots(spark.createDataFrame([(text,)], "t string"), "t")
    row = r.select("user_agents", "request_rate", "crawl_delay", *(politeness.is_allowed(F.lit(p), F.col("allowed_paths"), F.col("disallowed_paths")).alias(n) for n, p in (("a", "/x/y/z"), ("b", "/x/q"), ("c", "/")))).first()
    assert (row.user_agents, row.request_rate, row.crawl_delay, row.a, row.b, row.c) == (["a", "*"], None, None, True, False, True)
    assert r.select(politeness.wildcard_denies(F.lit("/q/a.pdf"), F.col("disallowed_paths")).alias("x")).first().x
    assert not r.select(politeness.wildcard_denies(F.lit("/q/a.pdfx"), F.col("disallowed_paths")).alias("x")).first().x


def test_html_selection(spark):
    page = "<div id=m class='a b'><p>1<p class=b>2</div><ul><li>x<li><a href=/q>l</a></ul><img src=i>" + "<div class=item>" * 5000
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    wanted = {"#m > p": ["1", "2"], "div .b": ["2"], "p:nth-of-type(2)": ["2"], "a[href^='/q']::text": ["l"], "ul > a": [], "a:hover": [], "#m": ["12"]}  # no page is in a browser's state
    got = {k: [] for k in wanted}
    for r in trees.select(df, {k: k for k in wanted}).orderBy("name", "pos").collect():
        got[r.name].append(r.value)
    assert got == wanted
    tree = F.col("tree")
    deep = trees.trees(df).select(F.size(trees.matches(tree, "div.item")).alias("n"), trees.path(tree, F.get(tree, F.lit(40)))[0].alias("path"), F.size(trees.ancestors(tree, F.get(tree, F.lit(4000)))).alias("up"), F.get(tree, F.lit(9))["up"].alias("written")).first()
    assert (deep.n, deep.up, deep.written) == (5000, 4000 - 8, None) and deep.path.count(" > ") == 40 - 8 - 1
    with pytest.raises(ValueError):
        trees.select(df, {"x": "a:nonsense"})


def test_sources(spark):
    assert io.parse_curl("wget x") is None and io.parse_curl("curl 'x") is None
    assert io.parse_curl("curl http://x -d a=1 -d b=2")["body"] == "a=1&b=2"
    assert one(spark, io.charset, "text/html") == "utf-8"


def test_upsert_prefers_new_on_ties(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 0, "e")], "k int, v int, x string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], "v").collect())) == [(1, 1, "c"), (2, 5, "b"), (3, 0, "e")]


def test_clusters_are_components(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.4), ("c", 0.8), ("d", 5.0), ("e", 7.0), ("f", 7.5)], "k string, x double")
    assert {r.k: r.cluster for r in inference.clusters(df, "k", ["x"]).collect()} == {"a": "a", "b": "a", "c": "a", "d": None, "e": "e", "f": "e"}


def test_empty_monitoring(spark):
    schema = "crawl_id string, ts timestamp, event_id long, url string, success boolean, blocked boolean, bytes long, response_time double, depth int"
    none = spark.createDataFrame([], schema)
    assert monitoring.counters(none).count() == 0
    assert monitoring.summary(monitoring.counters(none)).first().crawls == 0


def test_combined_duplicates_reach_every_member(spark, tmp_path):
    """Equal fingerprints of different texts, and near classes from either side, against all pairs."""
    from docloom.plans.rest_queries import d15_combined

    rnd = random.Random(2)
    bases = [" ".join(f"w{rnd.randrange(900)}" for _ in range(150)) for _ in range(12)]
    edited = [b.rsplit(" ", 1)[0] + " changed" for b in bases]
    texts = [f(x) for x in (*bases, *edited) for f in (str, str.upper, lambda t: t + " !", str)] + ["", "two words", "Two words"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    fps = {r.doc_id: r.fp for r in dedup.simhash(dedup.shingle_tokens(docs, "doc_id", "text"), "doc_id", "token").collect()}
    want = set()
    for d, t in enumerate(texts):
        near = [(a, ((fps[a] ^ fps[d]) & (2**64 - 1)).bit_count()) for a in range(d) if a in fps and d in fps]
        near = [x for x in near if x[1] <= 6]
        if t in texts[:d]:
            want.add((d, True, texts.index(t), 1.0))
        else:
            want.add((d, True, near[0][0], 1 - near[0][1] / 64) if near else (d, False, None, 0.0))
    got = [tuple(r) for r in d15_combined(spark, str(tmp_path)).select("doc_id", "is_duplicate", "duplicate_of", "similarity").collect()]
    assert len(got) == len(texts) and set(got) == want
    assert any(x[3] not in (0.0, 1.0) for x in want)


@pytest.mark.parametrize("min_samples", [1, 2, 4])
def test_density_clusters(spark, min_samples):
    """Against a plain breadth-first DBSCAN; borders join the first cluster of a core point near them."""
    r = random.Random(9)
    rows = [(i, *(round(r.choice([0, 2, 5]) + r.gauss(0, 0.35), 2) for _ in range(4))) for i in range(90)]
    rows += [(200 + i, 9.0, 9.0, 9.0, 9.0) for i in range(3)] + [(300, None, 1.0, 1.0, 1.0), (301, float("nan"), 1.0, 1.0, 1.0)]
    good = [x for x in rows if x[1] is not None and x[1] == x[1]]
    near = {a[0]: [b[0] for b in good if math.dist(a[1:], b[1:]) <= 0.5] for a in good}
    core = {k for k, v in near.items() if len(v) >= min_samples}
    want = dict.fromkeys((x[0] for x in rows), None)
    for k in sorted(core):
        if want[k] is None:
            todo = [k]
            want[k] = k
            while todo:
                for b in near[todo.pop()]:
                    if b in core and want[b] is None:
                        want[b] = k
                        todo.append(b)
    for k in near:
        if k not in core:
            want[k] = min((want[b] for b in near[k] if b in core), default=None)
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double").repartition(3)
    assert {x.k: x.cluster for x in inference.clusters(df, "k", ["a", "b", "c", "d"], 0.5, min_samples).collect()} == want
    assert inference.clusters(df.limit(0), "k", ["a", "b"]).count() == 0


@pytest.mark.parametrize("least", [0.9, 0.5, 0.2, -1.0])
def test_vector_search_loses_nothing(spark, least):
    g = np.random.default_rng(4)
    x = g.normal(size=(150, 6)) + 3 * (np.arange(150) % 3 == 0)[:, None]
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(x)] + [(500, None, "x"), (501, [0.0] * 6, "x"), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (503, [1.0] * 3, "x"), (504, [1e300] * 6, "x"), (504, [1e300] * 6, "x")]
    df = spark.createDataFrame(rows, "k long, v array<double>, cell string").repartition(4)
    index = vector_index.indexed(df, "k", "v", cells=7, sample=60)
    good = [(k, np.array(v, float) / max(map(abs, v))) for k, v, _ in rows if v and None not in v and any(v) and len(v) == 6]
    q = df.filter("k % 10 = 4")
    want = sorted((a, b) for a, x in good if a % 10 == 4 for b, y in good if a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least - 1e-12)
    got = sorted((r.query, r.key) for r in vector_index.search(index, q, "k", "v", least).collect())
    assert got == want and want
