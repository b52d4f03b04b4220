"""Selectors, healing, fuzzy pairs and SQLite tables against literals and brute force."""

import datetime
import difflib
import random
import re
import sqlite3

import pytest
from docloom.operators import dedup, fewshot, healing, html, learning, patterns, repair, trees
from docloom.sources import stores
from pyspark.sql import functions as F

from tests import walker

PAGE = """<html><body><div id="m" class="a b"><h1>T</h1><p>one</p><p class=x>two <b>bold</b></p><span></span></div><div data-k="v"><p>three</p></div></body></html>"""


def found(selector, page=PAGE):
    tree = html.parse(page)
    whole = walker.contents(tree)
    take = html.compile_selector(selector)[1]
    return [walker._value(n, take, whole) for n in walker.matches(tree, selector)]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("h1 + p", ["one"]), ("h1 ~ p", ["one", "two bold"]), ("p:nth-child(2n+1)", ["two bold", "three"]), ("p:not(.x)", ["one", "three"]), ("p:contains('bold')", ["two bold"]),
        ("p:last-of-type", ["two bold", "three"]), ("span:empty", [""]), ("div > p:first-child", ["three"]), ("p[class]", ["two bold"]), ('[data-k="v"] p, h1', ["T", "three"]), ("p.x::attr(class)", ["x"]),
        ("//div[@id='m']/p[2]", ["two bold"]), ("/html/body/div[2]/p", ["three"]), ("//p[contains(@class,'x')]/text()", ["two "]), ("//p[text()='one']", ["one"]), ("//*[@id='m']/h1 | //b", ["T", "bold"]), ("//p/@class", [None, "x", None]),
    ],
)
def test_selectors(selector, want):
    assert found(selector) == want


@pytest.mark.parametrize("selector", ["p:nonsense", "//p[position() > 1]", "", "p >> b"])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        found(selector)


def test_paths_find_their_node():
    tree = html.parse(PAGE)
    for full in (False, True):
        for n, (css, xpath) in zip(tree, walker.paths(tree, full), strict=True):
            if n.parent >= 0:
                assert n.id in [x.id for x in walker.matches(tree, css)], css  # a first one of its tag has no number
                assert full or n.id in [x.id for x in walker.matches(tree, xpath)], xpath
    assert html.to_xpath("nav > ul::text") == "descendant-or-self::nav/ul/text()"


def test_stable_selectors():
    tree = html.parse(PAGE)
    page = walker._Page(tree)
    for n in tree:
        assert [x.id for x in walker.matches(tree, walker.stable_xpath(page, n))] == [n.id]
        assert re.search(walker.stable_regex(PAGE, n), PAGE)[1] == PAGE[n.start : n.stop]
    assert [walker.stable_css(page, n) for n in tree] == ["html", "body", "#m", "h1", "p:nth-of-type(1)", "p.x", "b", "span", 'div[data-k="v"]', 'div[data-k="v"] > p']


ODD = ["", None, "<p>", "no markup", "<ul><li class='a b'>1<li class='a b'>2<li class='c'>3</ul><p>x<br>y", "<div id=q data-x='v'><b class='active k'>t</b><b class=k>u</b></div><div data-x='v'>z</div>", "<div>" * 25 + "deep"]


def test_columns_are_the_walk(spark):
    """Selectors, values and paths as column expressions against a walk over the tree."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").limit(40)
    rows = [(r.page_id, r.html) for r in pages.collect()] + [(-1 - i, p) for i, p in enumerate([PAGE, *ODD])]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    names = ["h1 + p", "h1 ~ p", "p:nth-child(2n+1)", "p:nth-child(-n+2)", "p:not(.x)", "p:contains('bold')", "p:last-of-type", "span:empty", "div > p:first-child", "p[class]", '[data-k="v"] p, h1', "p.x::attr(class)", "//div[@id='m']/p[2]", "/html/body/div[2]/p", "//p/text()", "//p[text()='one']", "//*[@id='m']/h1 | //b", "//p/@class", "div a, nav a, p", "body > *", "ul li:last-child", "*"]
    want = sorted(((k, s, i, v) for k, p in rows for s in names for i, v in enumerate(found(s, p))), key=str)
    assert sorted(map(tuple, trees.select(df, dict(zip(names, names, strict=True))).collect()), key=str) == want
    for full in (False, True):
        want = sorted((k, n, *x) for k, p in rows for n, x in enumerate(walker.paths(html.parse(p), full)))
        assert sorted(map(tuple, trees.selector_paths(df, full).collect())) == want
    want = []
    for k, p in rows:
        page = walker._Page(html.parse(p))
        at = walker.paths(page.tree)
        want += [(k, n.id, *at[n.id], walker.stable_css(page, n), walker.stable_xpath(page, n), walker.stable_regex(p or "", n)) for n in page.tree]
    assert sorted(map(tuple, trees.selector_forms(df, "*").collect())) == sorted(want)
    assert trees.select(df, {"x": r"re:<b>(\w+)"}).filter("page_id = -1").collect()[0].value == "bold"


def test_paths_known_with_the_page(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    tree = F.col("tree")
    ids = lambda css: [n.id for n in trees.trees(df).select(trees.chain(tree, F.lit(css)).alias("x")).first().x]
    for css in ("div.a > p.x", "p:nth-of-type(2)", "#m > h1", 'div[data-k="v"] > p', "html > body > div", "div.b.a", "gone > p"):
        assert ids(css) == [n.id for n in walker.matches(html.parse(PAGE), css)]
    adapt = lambda css, target: trees.trees(df).select(trees.adapted(tree, F.lit(css), F.array(F.lit(target))).alias("x")).first().x
    assert adapt("html > body > div > em", 1) == "html > body"
    assert adapt("em > b", 1) is None


def test_healing(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><div class='price tag'>12</div><div class=text>words</div></body></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    fields = {"a": healing.Field("span.price", ["<div class='price'>9</div>"]), "b": healing.Field("nav > a"), "c": healing.Field("span"), "d": healing.Field("b", ["<i>"], "image")}
    got = {(r.page_id, r.name): (r.css, round(r.confidence, 3) > 0) for r in healing.heal(df, fields).collect()}
    assert got == {(1, "a"): ("div.price.tag", True), (1, "b"): ("nav > a", True), (1, "c"): (None, False), (1, "d"): (None, False), (2, "a"): (None, False), (2, "b"): (None, False), (2, "c"): (None, False), (2, "d"): (None, False)}
    tree = F.col("tree")
    may = lambda tags, kind: [n.tag for n in trees.trees(df).filter("key = 1").select(trees.fields_like(tree, tags, kind).alias("x")).first().x]
    assert may(["nav", "div"], "link") == ["nav"] and may(["div"], "number") == ["div"] and may(["q"], "text") == ["a", "div", "div"]
    new = "<html><body><nav><a href=/>Home</a></nav><section><div class='price new'>12</div></section></body></html>"
    pairs = spark.createDataFrame([(1, page, new), (2, "", new), (3, page, None)], "page_id long, old string, new string")
    rows = healing.repairs(pairs, ["body > div.price"]).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.css) for r in rows][0] == (1, "div.price.new") and {r.page_id for r in rows} <= {1, 2}


def test_likeness(spark):
    a = "<ul><li class='k m' id=i data-a=1>one two three</li><li>q</li></ul>"
    b = "<ol><li class='m n'>two three four</li><li>q</li></ol>"
    df = spark.createDataFrame([(1, a, b)], "page_id long, a string, b string")
    x = trees.trees(df, "page_id", "a").select(repair.features(F.col("tree"), F.get("tree", F.lit(1))).alias("f"), repair.features(F.col("tree"), F.get("tree", F.lit(2))).alias("g"))
    y = trees.trees(df, "page_id", "b").select(repair.features(F.col("tree"), F.get("tree", F.lit(1))).alias("h"))
    r = x.crossJoin(y).select(repair.likeness(F.col("f"), F.col("h")).alias("fh"), repair.likeness(F.col("f"), F.col("g")).alias("fg"), repair.likeness(F.col("g"), F.col("g")).alias("gg")).first()
    assert r.fh == pytest.approx((1 + 1 / 3 + 2 / 4 + 0) / 4)
    assert r.fg == pytest.approx((1 + 0 + 0 + 0 + 0) / 5)  # tag; classes, texts, attributes and the place differ
    assert r.gg == 1.0  # classes and attributes of neither don't count


def test_groups_and_their_common_parent(spark):
    df = spark.createDataFrame([(1, "<ul class='menu x'><li class='a b'>1<li class='a b'>2<li class='c'>3</ul><p>x"), (2, "<p>a<p>b")], "page_id long, html string")
    assert sorted((r.page_id, r.first_id, r.n, r.last_id) for r in patterns.grouped(df).collect()) == [(1, 1, 2, 2), (2, 0, 2, 1)]
    assert [tuple(r) for r in patterns.patterns(df).collect()] == [(1, ".menu > li:nth-child(n)", 0, 2, 2 / 3)]


def test_adapted_selectors(spark):
    case = lambda css, tag, **attrs: spark.range(1).select(fewshot.adapted(F.lit(css), F.lit(tag), F.create_map(F.lit("_"), F.lit(""), *(F.lit(x) for kv in attrs.items() for x in (kv[0].rstrip("_"), kv[1])))).alias("x")).first().x
    assert case("div.item-big", "section", class_="item-small q") == "section.item-small"
    assert case("div.item", "p", class_="item") is None
    assert case('a[href="/x"]', "a", href="/y") == 'a[href="/y"]'
    assert case("#q > span.k", "b", class_="z") == "#q > b"
    g = lambda text: spark.range(1).select(fewshot.grams(F.lit(text)).alias("x")).first().x
    assert sorted(g("ab C")) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


@pytest.mark.parametrize("least", [0.6, 0.85])
def test_no_fuzzy_pair_is_lost(spark, least):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 14))) for _ in range(120)]
    texts += [t[:3] + rnd.choice("xyz") + t[4:] for t in texts[:40]] + [None, "", "q" * 300, "q" * 290 + "r" * 10]
    rows = [(i, t) for i, t in enumerate(texts)]
    first = {}
    for i, t in rows:
        if t is not None:
            first.setdefault(t, i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and a and b and difflib.SequenceMatcher(None, a, b).ratio() >= least}
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    assert {(r.a, r.b) for r in learning.fuzzy_pairs(df, "k", "t", least).collect()} == want and want


def test_fuzzy_first_seen(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ab ") for _ in range(8))) for i in range(60)]
    kept, want = [], {}
    for i, t in rows:
        hit = next(((k, o) for k, o in kept if t == o or difflib.SequenceMatcher(None, o, t).ratio() >= 0.85), None)
        want[i] = hit and hit[0]
        if hit is None:
            kept.append((i, t))
    got = {r.k: r.duplicate_of for r in dedup.fuzzy_first_seen(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == want and len(kept) < 60


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE sessions (id INTEGER PRIMARY KEY, tag TEXT, used REAL)")
        c.execute("CREATE TABLE none (id INTEGER)")
        c.executemany("INSERT INTO sessions VALUES (?, ?, ?)", [(3 * i, f"t{i}" if i % 4 else None, i / 2) for i in range(50)])
    stores.register(spark)
    load = lambda table: spark.read.format(stores.FORMAT).option("table", table).load(path)
    df = load("sessions")
    assert df.schema.simpleString() == "struct<id:bigint,tag:string,used:double>" and df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect())) == sorted((3 * i, f"t{i}" if i % 4 else None, i / 2) for i in range(50))
    assert load("none").count() == 0
    with pytest.raises(Exception, match="no table name"):
        load("a; drop").count()


def test_only_committed_shards_count(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.register(spark)
    schema = "k long, s string, b boolean, d double, x binary, t timestamp, day date"
    rows = [(i, None if i % 5 == 0 else f"s{i}", i % 2 == 0, i / 3, bytes([i]), datetime.datetime(2024, 1, 1, 0, 0, i, 5), datetime.date(2024, 1, i + 1)) for i in range(20)] + [(None,) * 7]
    df = spark.createDataFrame(rows, schema).repartition(3)
    write = lambda d, mode: d.write.format(stores.FORMAT).option("table", "t").mode(mode).save(path)
    load = lambda: spark.read.format(stores.FORMAT).option("table", "t").load(path)
    write(df, "append")
    assert sorted(load().collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(Exception):  # noqa: B017  one task fails, so nothing of the job is kept
        write(df.withColumn("k", F.when(F.col("k") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("k"))), "append")
    assert load().count() == 21
    write(df.limit(4), "append")
    assert load().count() == 25
    write(df.limit(0), "overwrite")
    assert load().count() == 0


def test_checked_rows(spark, tmp_path):
    inner = stores.SqliteStorage(spark, str(tmp_path / "c"), "c", ["k"], "v")
    store = stores.CheckedStorage(inner, "k long, v int, s string")
    store.save(spark.createDataFrame([(1, 1, "a" * 5000), (2, 1, None)], "k long, v int, s string"))
    store.save(spark.createDataFrame([(1, 2, "b")], "k long, v int, s string"))
    assert len(inner.load().orderBy(F.length("data")).collect()[-1].data) < 100
    assert sorted(map(tuple, store.newest().collect()), key=str) == [(1, 2, "b"), (2, 1, None)]
    with sqlite3.connect(stores.shards(str(tmp_path / "c"))[0]) as c:
        c.execute("UPDATE c SET data = substr(data, 1, 4)")
    assert store.checked().filter("NOT intact").count() >= 1
    assert store.load().count() + store.checked().filter("NOT intact").count() == 3
    assert stores.unpack(None, "") is None


def test_features_of_a_page_once_for_all_selectors(spark):
    """The most similar element for each selector, as likeness pair by pair says, from one pass over the page's elements."""
    old = "<html><body><div class='a b'><h1>One two three</h1></div><ul><li>x</li><li>y z</li></ul></body></html>"
    new = "<html><body><div class='b c'><h2>One two</h2><h1>three two One</h1></div><ul><li>y</li><li>y z w</li></ul></body></html>"
    df = spark.createDataFrame([(1, old, new), (2, None, new), (3, old, None)], "page_id long, old string, new string")
    wanted = {"title": "h1", "item": "li", "none": "video"}
    was, now = F.col("was"), F.col("tree")
    pairs = trees.trees(df.filter("page_id = 1"), "page_id", "old").select(F.col("tree").alias("was")).crossJoin(trees.trees(df.filter("page_id = 1"), "page_id", "new").select("tree"))
    want = set()
    for name in ("title", "item"):
        each = pairs.select("tree", "was", F.explode(trees.matches(was, wanted[name])).alias("o")).select("tree", "was", "o", F.explode(now).alias("n"))
        scored = each.select(repair.likeness(repair.features(now, F.col("n")), repair.features(was, F.col("o"))).alias("s"), "n.id").collect()
        s, at = max((r.s, -r.id) for r in scored)
        want |= {(1, name, -at, round(s, 9))} if s >= 0.7 else set()
    got = repair.repaired(df, wanted)
    assert len(want) == 2 and {(r.page_id, r.name, r.node_id, round(r.similarity, 9)) for r in got.collect()} == want
    # before a row is made for each selector, not after
    assert any("Generate explode" in line and "regexp_replace" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
