"""Main text and WARC derivatives."""

import base64
import gzip
import hashlib
import html as entities
import re
import time

import pytest

from docloom.llm import html_extraction, warc


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def visible(page):
    """The text of a page by regular expressions: a line for each stretch between tags that aren't inline."""
    page = re.sub(r"(?is)<!--.*?-->|<!.*?>|<(script|style|title)\b.*?</\1>", "", page)
    page = re.sub(r"(?i)<br\s*/?>", " ", page)
    page = re.sub(r"(?i)</?(?:a|b|i|em|strong|span)\b[^>]*>", "", page)
    parts = (" ".join(entities.unescape(x).split()) for x in re.split(r"<[^>]*>", page))
    return "\n".join(x for x in parts if x)


def test_article_of_every_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_what_is_no_main_text():
    page = """<html><head><title>x</title></head><body><header class="site-header">Site</header><nav>menu</nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Title</h1></header><p>Para one &amp; two.
    <p>Second<br>line</p><aside>side</aside><div class="ad">Buy</div><script>var t="</p>";</script><ul><li>a<li>b</ul></article>
    <section class="comments"><article class="comment"><p>nice</p></article></section></main><form>f<input></form><footer>foot</footer>"""
    assert html_extraction.main_text(page) == "Title\nPara one & two.\nSecond line\na\nb"


def test_surge_and_dive_without_article():
    long = "long text of the story goes on " * 8
    page = f"<div class='menu'><a href=x>Home</a></div><div><a href=a>one link</a></div><div><p>{long}</p><p>short.</p><p>{long}</p></div><div id=footer>imprint</div>"
    assert html_extraction.main_text(page) == "\n".join([long.strip(), "short.", long.strip()])


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no markup"), (None, "u", "<p>x"), (5, "u", "<div>" * 5000 + "deep" + "</div>" * 5000), (6, "u", "<p a='>'>q</p><!-- x <p>"), (6, "u", "<p a='>'>q</p><!-- x <p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_extraction.extract(df).collect()) == ["", "", "deep", "no markup", "q", "q", "x"]
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_warc_links_digests_and_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "http://a/b\r\nX: y", "<p>é &amp; ü</p>")], "page_id long, url string, html string")
    sources = warc.responses(pages.unionByName(odd))
    made = warc.derive(sources)
    by_id = {r.record_id: r for r in sources.collect()}
    rows = made.collect()
    assert len(rows) == 2 * len(by_id)
    for r in rows:
        source = by_id[r.refers_to]
        assert (r.refers_to_target_uri, r.refers_to_date) == (source.target_uri, source.date)
        assert r.block_digest == sha1(r.block) and r.content_length == len(r.block.encode())
        payload = warc.split_response(source.block)[1]
        if r.record_type == "conversion":
            assert r.block == visible(payload) and r.payload_digest == sha1(r.block)
        else:
            assert f"source-payload-digest: {sha1(payload)}" in r.block and "source-header-content-type: text/html" in r.block
    warc.write(sources.unionByName(made), str(tmp_path / "w"))
    found = [x for f in (tmp_path / "w").glob("*.gz") for x in warc.parse(gzip.decompress(f.read_bytes()))]
    assert sorted((h["WARC-Record-ID"], b.decode()) for h, b in found) == sorted((r.record_id, r.block) for r in [*by_id.values(), *rows])
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((r.record_id, r.refers_to or "", r.block) for r in back) == sorted((r.record_id, r.refers_to or "", r.block) for r in [*by_id.values(), *rows])
    assert warc.derive(warc.responses(odd.limit(0))).count() == 0


def test_warc_of_long_and_repeated_pages(spark):
    rows = [(1, "u", "<p>" + "long text " * 300_000), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (None, "u", "<p>x</p>")]
    made = warc.derive(warc.responses(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, block string"))).collect()
    assert len(made) == 8 and sorted(len(r.block) for r in made if r.record_type == "conversion") == [1, 1, 1, 10 * 300_000 - 1]
    two = [r for r in made if r.page_id == 2]
    assert two[0] in two[2:] and {r.page_id for r in made} == {1, 2, None}


def test_many_records_are_parsed_in_proportion_to_their_size():
    one = warc.response(1, "http://a/", "<p>x</p>")
    data = (one["headers"] + "\r\n" + one["block"] + "\r\n\r\n").encode() * 40_000
    began = time.time()
    assert len(warc.parse(data)) == 40_000 and time.time() - began < 10


def test_link_lines_inside_an_unmarked_story_are_kept():
    from docloom.llm.html_extraction import main_text

    a, b = "An opening paragraph of the story " * 5, "A closing paragraph of the story " * 5
    page = f"<body><div><p>{a}</p><p><a href='/x'>A paragraph that is all link</a></p><p>{b}</p></div><nav><a href='/'>Home</a></nav></body>"
    assert main_text(page).split("\n") == [a.strip(), "A paragraph that is all link", b.strip()]


STORY = ["An opening paragraph of the story " * 5, "Middle of the story, told at some length " * 4, "The end."]


def test_short_ends_and_link_lines_of_a_box_are_kept():
    links = "".join(f"<p><a href='/{i}'>link paragraph {i}</a></p>" for i in range(4))
    menu = "".join(f"<li><a href='/{i}'>page {i}</a></li>" for i in range(6))
    page = f"<body><ul>{menu}</ul><div><p>{STORY[0]}</p><p>{STORY[1]}</p>{links}<p>{STORY[2]}</p><ul><li><a href=x>its source</a></li></ul></div><div><ul>{menu}</ul></div><p>imprint</p>"
    want = [STORY[0].strip(), STORY[1].strip(), *(f"link paragraph {i}" for i in range(4)), STORY[2], "its source"]
    assert html_extraction.main_text(page).split("\n") == want
    inside = f"<div><ul>{menu}</ul><p>{STORY[0]}</p><p>{STORY[2]}</p><ul>{menu}</ul></div>"
    assert html_extraction.main_text(inside).split("\n") == [STORY[0].strip(), STORY[2]]


def test_one_name_among_others_does_not_empty_a_page():
    page = f"<div class='story related-story'><p>{STORY[0]}</p><p>{STORY[1]}</p></div><div class='box related-links'><p>Read this too</p></div><div class='comments-list'><p>{STORY[0] * 9}</p></div>"
    assert html_extraction.main_text(page).split("\n") == [STORY[0].strip(), STORY[1].strip()]


def test_surge_and_dive_choose_among_marked_elements():
    page = f"<article><p>A teaser.</p></article><article><h1>Title</h1><p>{STORY[0]}</p><p>{STORY[2]}</p></article><p>{STORY[1] * 3}</p>"
    assert html_extraction.main_text(page).split("\n") == ["Title", STORY[0].strip(), STORY[2]]
    assert html_extraction.main_text("<article><p>All of it.</p></article><p>Something else, and longer</p>") == "All of it."
    assert html_extraction.main_text("<nav><a href=x>Home</a></nav><p><a href=y>One link</a></p>") == "One link"


def test_very_long_pages():
    page = "<div>" + "".join(f"<p>{STORY[0]}{i}</p>" for i in range(20_000)) + "</div>"
    assert html_extraction.main_text(page).count("\n") == 19_999
    assert len(html_extraction.main_text(f"<p>{'word ' * 400_000}")) == 5 * 400_000 - 1


TALE = ["A long sentence of the story that is told here, and then some more of it. " * 3, "And it goes on and on with another paragraph of quite some length, as stories do. " * 2]


def story(n=2):
    return "".join(f"<p>{x}</p>" for x in TALE[:n])


TOLD = "\n".join(x.strip() for x in TALE)


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='widget'>{story()}</div>",
        f"<div class='post share'>{story()}</div>",
        f"<article class='header'>{story()}</article>",
        f"<div class='post social-story'><p>{TALE[0]}</p></div><div class='post header-story'><p>{TALE[1]}</p></div>",
        f"<article>{story()}</article><div class='ad'>Buy this now, it is a very good thing to buy for you</div>",
        f"<div class=ad/>An advert after a slash that ends nothing</div><article>{story()}</article>",
        f"<article>{story()}<div class='share'>Tell others</div></article><section class='comments'><article class='comment'>{story()}</article></section>",
        f"<article>{story()}</article><div class='comment-list'>{story()}{story()}</div>",
        f"<article class='post'>{story()}</article><article class='teaser'><a href=x>More of it</a> and a word</article>",
    ],
)
def test_no_name_empties_a_page(page):
    assert html_extraction.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>f</footer></body></html>") == TOLD


def test_deep_doubts_take_linear_time():
    deep = "<div class='promo box'>" * 16_000 + story() + "</div>" * 16_000
    began = time.perf_counter()
    assert html_extraction.main_text(deep) == TOLD
    assert time.perf_counter() - began < 4
