"""Queries of pages against their SQL, on pages with elements left open, with cut references, and with nothing to find."""

from collections import Counter

import duckdb
import pytest
from docloom.plans import registered

QUERIES, SQL = registered()
HEAD = '<!DOCTYPE html><html lang="en"><head><title>{0}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/the">the</a></li></ul></nav><div class="ad">{1}</div>'
PAGE = HEAD + "<article><h1>{0}</h1>{2}</article><footer>&copy; the.example.org {1}</footer>"
OPEN = "<p><b>x<br>"
PAGES = [
    PAGE.format("Plain &amp; &quot;whole&quot;", "buy", "<p>y</p>"), PAGE.format("cut &amp", "cut &am", OPEN), PAGE.format("cut &quo", "&", "<p>&amp</p><p>z</p>"), PAGE.format("deep", "buy", OPEN * 70),
    PAGE.format("the &a", "the title", OPEN * 200) + "</body></html>", None, "", HEAD.format("no article", "x"),
    PAGE.format("\xa0ends in separators\u2003", "&nbsp;x&nbsp; ", "<p>\xa0<p>y\u3000<p>\t z\n"),
    HEAD.format("x", "y").replace(">the<", ">&nbsp;<"),
    PAGE.format("a\x0bb-c\td", "*\x0b.", "<p>\x0b\x0c"),
]
NAMES = ["sel4_first", "gen5_scores", "rep8_structure", "sel1_css", "sel8_paths", "sup15_features", "txt_unescape", "sel12_dicts", "sup11_described", "gen13_describe", "ext4_typed", "gen9_stable"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, f"http://h/{i}", x) for i, x in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql_on_odd_pages(spark, odd, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{odd}/pages.parquet/*.parquet'")
    df = QUERIES[name](spark, odd)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)
