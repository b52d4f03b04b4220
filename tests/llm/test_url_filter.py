"""URL rules and link-graph propagation."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from docloom.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host int, rule string"


def a(*urls):
    return "".join(f'<p>x <a class=k href="{u}">y</a>' for u in urls)


PAGES = [
    (1, "http://good.org/a", a("http://friend.net/x", "http://friend.net/y", "/local", "http://neutral.net/")),
    (2, "https://x.com/de/1", a("http://farm.net/")),
    (3, "http://farm.net/p", a("http://X.com/de/9?q", "http://friend.net/")),
    (4, "http://farm.net/q", a("//x.com/de/9")),
    (5, "http://friend.net/", a("http://neutral.net:80/#f")),
    (6, "http://neutral.net/", "<!-- " + a("http://x.com/") + " --><script>" + a("http://x.com/") + "</script>" + a("http://leaf.net/")),
    (7, "http://EXAMPLE.org/es/1", a("http://leaf.net")),
    (8, "http://example.org/es", None),
    (9, "http://sub.example.org/en/148.html?x=http://a/b", a("http://leaf.net/")),
    (10, "http://notexample.org/es/1", "<a href='http://neutral.net/'>q"),
    (11, "http://far.net/", a("http://farm.net/", "http://farm.net/2")),
    (12, "http://org", ""),
    (13, "http://org/", ""),
    (14, "no scheme", a("http://x.com/")),
    (15, None, a("http://x.com/")),
    (16, "", "<!-- open " + "<a " * 50),
    (17, "http:///path?q", ""),
    (18, "http://x.com?/de/", ""),
    (19, "http://mixed.com/fr/1", ""),
    (20, "http://mixed.com/de/1", ""),
    (21, "http://mixed.com/de/2", ""),
    (21, "http://mixed.com/de/2", ""),
    (22, "http://mixed.com/en/2", ""),
    (None, "http://x.com/fr/é", "<a title='ab' href=http://leaf.net>"),
]


def brute(pages, rules, damping=U.DAMPING, rounds=300):
    """Verdicts with dense propagation, page by page."""
    parts, links, seeds = [], defaultdict(Counter), {"allow": Counter(), "block": Counter()}
    for i, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, act) for act, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, action = max(fits, default=(0, None, None))
        parts.append((i, host, path, rule, action))
        if action and host:
            seeds[action][host] += 1
        html = re.sub(r"(?is)<!--.*?(-->|$)|<script.*?</script", " ", html or "")
        found = {u.lower() for u in re.findall(r"""(?i)<a\s[^<]*?href=["']?(?:http:)?//([^/?#"'\s<>]+)""", html)}
        links[host].update(found - {host} if host else ())
    total = sum(seeds["allow"].values()) + sum(seeds["block"].values())
    back = defaultdict(Counter)
    for s, to in links.items():
        for d, n in to.items():
            back[d][s] += n

    def spread(start, edges):
        score, mass = Counter(), {h: n / total for h, n in start.items()}
        for _ in range(rounds):
            moved = Counter()
            for h, m in mass.items():
                score[h] += (1 - damping) * m
                for d, n in edges[h].items():
                    moved[d] += damping * m * n / sum(edges[h].values())
            mass = moved
        return score

    trust, distrust = spread(seeds["allow"], links), spread(seeds["block"], back)
    judged = {h: "block" if distrust[h] > 0.5 * (trust[h] + distrust[h]) else "allow" for _, h, *_ in parts}
    return [(i, h, p, r, act or judged[h]) for i, h, p, r, act in parts], trust, distrust


def frame(spark, pages):
    return spark.createDataFrame([(*p, 1, "r") for p in pages], SCHEMA)


def test_verdicts_against_dense_propagation(spark):
    rows = U.judge(frame(spark, PAGES), U.rule_table(spark), damping=0.5, tolerance=1e-5).collect()
    want, trust, distrust = brute(PAGES, U.RULES, 0.5)
    order = lambda rows: sorted(rows, key=str)
    assert order((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == order(want)
    for r in rows:
        assert r.trust == pytest.approx(trust[r.host], abs=2e-5)
        assert r.distrust == pytest.approx(distrust[r.host], abs=2e-5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[3] == ("farm.net", "/p", None, "block")  # links to a blocked host
    assert got[11][3] == "block"  # and so does who links to it
    assert got[5] == ("friend.net", "/", None, "allow")
    assert got[12][2] is None and got[13][2] == "org/"
    assert got[15] == got[14] == ("", "", None, "allow")
    assert got[18] == ("x.com", "", None, "block")
    assert got[22][3] == "block"


def test_by_sql(spark, sf):
    duck = duckdb.connect()
    duck.register("made", frame(spark, PAGES).toPandas())
    duck.execute("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM made")
    want = duck.execute(U.SQL).fetchall()
    got = U.judge(frame(spark, PAGES), U.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    duck.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(str, duck.execute(U.SQL).fetchall())) == sorted(str(tuple(r)) for r in U.op11_url_filter(spark, sf).collect())


def test_rules(spark):
    rules = [("allow", "b.org", "/"), ("block", "a.b.org", "/"), ("allow", "A.b.org", "/x"), ("block", "net", None), ("allow", "net", ""), (None, "z", "/"), ("block", None, "/")]
    pages = [(1, "http://a.b.org/x", ""), (2, "http://a.b.org/y", ""), (3, "http://c.b.org/x", ""), (4, "http://ab.org/x", ""), (5, "http://k.net", ""), (6, "http://z/", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(frame(spark, pages), U.rule_table(spark, rules)).collect()}
    assert got == {1: ("a.b.org/x", "allow"), 2: ("a.b.org/", "block"), 3: ("b.org/", "allow"), 4: (None, "allow"), 5: ("net", "block"), 6: (None, "allow")}


def test_no_rules_no_pages_and_a_hot_host(spark):
    pages = frame(spark, PAGES)
    assert {r.verdict for r in U.judge(pages, U.rule_table(spark).limit(0)).collect()} == {"allow"}
    assert U.judge(pages.limit(0), U.rule_table(spark)).count() == 0
    # the hub links to hosts that it also gets all its links from
    hot = [(i, f"http://hub.net/{i}", a(f"http://n{i % 7}.com/de/")) for i in range(300)] + [(1000 + i, f"http://n{i}.com/de/", a("http://hub.net/")) for i in range(7)]
    rows = U.judge(frame(spark, hot).repartition(5), U.rule_table(spark)).collect()
    want, *_ = brute(hot, U.RULES)
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in rows) == sorted(map(str, want))


def test_very_long_pages(spark):
    pages = [(1, "http://a.net/" + "x" * 100_000, "<a href=http://b.com/de/>" + "<!--" * 100_000), (2, "http://b.com/de/", "<a " * 200_000 + "href='" * 10_000), (3, "http://" + "l." * 50_000 + "org/", "<script>" * 100_000)]
    got = {r.page_id: r.verdict for r in U.judge(frame(spark, pages), U.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
