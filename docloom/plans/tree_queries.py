"""Queries of operators on the node table, with SQL over a node table that SQL parses itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import healing as Z
from docloom.operators import html as H
from docloom.operators import learning as L
from docloom.operators import trees as R
from docloom.plans.node_sql import NODES


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _nodes(spark, sf_dir):
    return H.nodes(_pages(spark, sf_dir))


def sel2_xpath(spark, sf_dir):
    """CSS as location paths, for the selectors of every element and what stands below and beside it."""
    c = H.candidates(_nodes(spark, sf_dir)).select("selector").distinct()
    forms = {"own": "{}", "below": "{} > p::text", "inside": "article {}", "beside": "nav + {}::attr(class)", "after": "nav ~ {}"}
    rows = c.select("selector", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.replace(F.lit(v), F.lit("{}"), "selector").alias("css")) for k, v in forms.items()))).alias("x")).select("x.*")
    return H.xpaths(rows, "css").select("form", "css", "xpath")


def sel1_css(spark, sf_dir):
    """Combinators and pseudo-classes."""
    wanted = {"beside": "nav ~ article", "next": "article + footer", "not": "div:not(.ad), article > p:not(:first-of-type)", "second": "li:nth-child(2)", "odd": "ul > li:nth-child(2n+1)", "last": "li:last-child", "holds": "footer:contains('example')", "hover": "a:hover"}
    return R.select(_pages(spark, sf_dir), wanted).groupBy("page_id", "name").agg(F.count("*").alias("n"))


def sel6_dispatch(spark, sf_dir):
    """CSS, a path and a regular expression, told apart by their form."""
    wanted = {"css": "title", "path": "//head/title/text()", "regex": "re:(?s)<title>(.*?)</title>", "link": "//nav/ul/li[1]/a", "attr": "/html/@lang"}
    return R.select(_pages(spark, sf_dir), wanted).select("page_id", "name", "pos", "value")


def sel7_unique(spark, sf_dir):
    found = R.select(_pages(spark, sf_dir), {"h1": "h1", "li": "nav li"})
    return L.unique_selector(found, ["page_id", "name"])


def sel8_paths(spark, sf_dir):
    return R.selector_paths(_pages(spark, sf_dir))


def sel9_similar(spark, sf_dir):
    """Elements like the first one of each page with the text of its first link."""
    tree = _nodes(spark, sf_dir)
    text = tree.filter("tag = 'a'").groupBy("page_id").agg(F.min_by(F.trim("text"), "node_id").alias("wanted"))
    return L.find_similar(tree, L.with_text(tree.join(text, "page_id"), F.col("wanted")))


def sel12_dicts(spark, sf_dir):
    d = R.element_dicts(_pages(spark, sf_dir))
    return d.select("page_id", "node_id", "tag", F.to_json("attributes").alias("attributes"), F.md5("text").alias("text_md5"), F.array_join("path", "/").alias("path"), "parent_name", F.to_json("parent_attribs").alias("parent_attribs"), F.md5("parent_text").alias("parent_md5"), F.array_join("siblings", ",").alias("siblings"), F.array_join("children", ",").alias("children"))


def ext4_typed(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    v = lambda kind: L.typed_value(F.col("tag"), F.col("attrs"), F.col("text"), kind).alias(kind)
    return n.filter("tag IN ('a', 'li', 'h1', 'footer', 'div')").select("page_id", "node_id", v("url"), v("image"), v("number"), v("text"))


def gen2_context(spark, sf_dir):
    """Selectors from the parent's class and the sibling before."""
    return L.context_selectors(_nodes(spark, sf_dir)).groupBy("selector").agg(F.count("*").alias("n"))


def gen4_scored(spark, sf_dir):
    """Candidates by coverage and precision over pages, and their stability."""
    wanted = {"h1": "article h1", "p": "article > p", "ad": "div.ad", "foot": "footer", "none": "video"}
    return L.scored_selectors(_pages(spark, sf_dir), wanted).select("name", "css", *(F.round(c, 6).alias(c) for c in ("coverage", "precision", "stability", "score")))


def gen5_scores(spark, sf_dir):
    s = L.context_selectors(_nodes(spark, sf_dir)).select("selector").distinct().select(F.explode(F.array("selector", F.concat(F.lit("body > article > "), "selector", F.lit(" > b:nth-child(2)")))).alias("css"))
    tried = F.array_join(F.transform(H.loosened(F.col("css")), lambda x: F.concat(x["css"], F.lit("="), x["confidence"].cast("string"))), ";")
    return s.select("css", H.specificity(F.col("css")).cast("long").alias("specificity"), F.round(H.stability(F.col("css")), 6).alias("stability"), tried.alias("loosened"))


def gen8_confidence(spark, sf_dir):
    c = H.candidates(_nodes(spark, sf_dir)).groupBy("page_id", "selector").agg(F.count("*").alias("n"))
    return c.select("page_id", "selector", F.round(L.selector_confidence(F.col("selector"), F.col("n") == 1), 6).alias("confidence"))


def gen9_stable(spark, sf_dir):
    return R.selector_forms(_pages(spark, sf_dir), "h1, footer, nav, div.ad, ul").select("page_id", "node_id", "stable_css", "stable_xpath", "regex")


def gen11_fallbacks(spark, sf_dir):
    """For each kind of element the three best candidates."""
    g = L.counted_candidates(_nodes(spark, sf_dir).filter("tag IN ('div', 'html', 'meta')"))
    return L.fallbacks(g, 3)


def gen13_describe(spark, sf_dir):
    tree = _nodes(spark, sf_dir)
    return L.describe_score(tree, "the ad title").select("page_id", "node_id", F.round("score", 6).alias("score"))


def sup11_described(spark, sf_dir):
    """Three selectors a page for a description: of its best-scored elements."""
    return L.selectors_for(_pages(spark, sf_dir), "the ad title", 3)


def rep4_signatures(spark, sf_dir):
    s = H.signatures(_nodes(spark, sf_dir))
    return H.by_signature(s, s).select("page_id", "old_id", "new_id")


def rep5_loosened(spark, sf_dir):
    """The repairs of broken selectors that match something, on each page."""
    broken = F.explode(F.array(F.lit("body > article.story > div.gone > h1"), F.lit("html > body > nav.menu > ul.gone > li"), F.lit("body > div.ad.gone"))).alias("broken")
    tried = R.trees(_pages(spark, sf_dir)).select("key", "tree", broken).select("key", "tree", "broken", F.posexplode(H.loosened(F.col("broken"))).alias("place", "x"))
    hit = tried.withColumn("n", F.size(R.chain(F.col("tree"), F.col("x.css")))).filter("n > 0")
    return hit.select(F.col("key").alias("page_id"), "broken", "place", "x.css", "x.confidence", "n")


def rep6_rerank(spark, sf_dir):
    """Candidates of one page tried on the next by number: those that match gain, others lose."""
    c = H.candidates(_nodes(spark, sf_dir)).groupBy("page_id", "selector").agg(F.max("confidence").alias("score"))
    there = c.select((F.col("page_id") - 1).alias("page_id"), "selector", F.lit(True).alias("hit"))
    return L.reranked(c.join(there, ["page_id", "selector"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))).select("page_id", "selector", F.round("score", 6).alias("score"))


def rep8_structure(spark, sf_dir):
    s = H.structure(_nodes(spark, sf_dir))
    return s.select("page_id", "n", F.round("depth_mean", 6).alias("depth_mean"), F.round("depth_std", 6).alias("depth_std"), "depth_max", "dom_hash", F.array_join(F.transform("vector", lambda x: F.format_number(x, 6)), " ").alias("vector"))


def sup4_heal(spark, sf_dir):
    fields = {"ad": Z.Field("div.missing", ["<div class='ad'>Buy</div>"]), "kept": Z.Field("article > h1"), "menu": Z.Field("ol.menu", ["<nav><ul><li><a href='/x'>x</a></li></ul></nav>"], "link"), "lost": Z.Field("video")}
    h = Z.heal(_pages(spark, sf_dir), fields)
    return h.select("page_id", "name", "css", (F.col("similarity") >= 0.3).cast("int").alias("healed"))


def sup5_candidates(spark, sf_dir):
    tree = F.col("tree")
    kinds = F.array(*(F.struct(F.lit(kind).alias("data_type"), F.size(R.fields_like(tree, ["li", "div", "nav"], kind)).alias("n")) for kind in ("text", "link", "image", "number")))
    return R.trees(_pages(spark, sf_dir)).select(F.col("key").alias("page_id"), F.explode(kinds).alias("x")).select("page_id", "x.*")


def sup6_top(spark, sf_dir):
    """The five best selectors of each kind of element among its ten best candidates by count."""
    c = L.counted_candidates(_nodes(spark, sf_dir))
    ten = c.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "selector"))).filter("r <= 10")
    return ten.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("confidence"), F.desc("n"), "selector"))).filter("place <= 5").select("tag", "place", "selector", "confidence", "n")


def sup7_repairs(spark, sf_dir):
    """The best repairs on a page whose advert and list have changed."""
    p = _pages(spark, sf_dir)
    new = F.replace(F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="advert ad-box">')), F.lit("<ul>"), F.lit('<ul class="menu">'))
    pairs = p.select("page_id", F.col("html").alias("old"), new.alias("new"))
    return Z.repairs(pairs, ["body > div.ad", "nav > ul.gone > li"]).withColumn("score", F.round("score", 6))


def sup8_adapt(spark, sf_dir):
    """Paths with parts that the page lacks, trimmed until they hit the last paragraph."""
    tree, n = F.col("tree"), F.col("n")
    last = R.trees(_pages(spark, sf_dir)).select("key", "tree", F.try_element_at(R.matches(tree, "p"), F.lit(-1)).alias("n")).filter("n IS NOT NULL")
    path = last.withColumn("path", R.path(tree, n)[0])
    return path.select(F.col("key").alias("page_id"), "path", R.adapted(tree, F.concat("path", F.lit(" > em > x:nth-of-type(9)")), F.array(n["id"])).alias("adapted"))


def sup15_features(spark, sf_dir):
    f = L.features(_nodes(spark, sf_dir))
    return f.groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("deepest"), F.sum(F.size("names")).cast("long").alias("attributes"))


def conv2_markdown(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(H.to_markdown(F.col("html"))).alias("markdown_md5"))


# SQL

_DYNAMIC = "regexp_matches({x}, '(?i)^[a-f0-9]{{8,}}$|^\\d{{10,}}$|^[A-Za-z0-9+/]{{20,}}={{0,2}}$|^session|^temp|^generated')"
_CLASSES = "list_filter(string_split_regex(coalesce({n}.attrs['class'], ''), '\\s+'), lambda c: c <> '')"
_CANDIDATES = f""", cand AS (SELECT page_id, node_id, tag, x.s AS selector, x.c AS confidence FROM (
  SELECT page_id, node_id, tag, unnest(list_concat(list_concat(
    CASE WHEN attrs['id'] IS NOT NULL THEN [{{'s': '#' || attrs['id'], 'c': 0.9::DOUBLE}}] ELSE [] END,
    CASE WHEN len({_CLASSES.format(n='nodes')}) > 1 THEN [{{'s': tag || '.' || array_to_string({_CLASSES.format(n='nodes')}, '.'), 'c': 0.7::DOUBLE}}] ELSE [] END),
    list_concat(list_transform({_CLASSES.format(n='nodes')}, lambda c: {{'s': tag || '.' || c, 'c': 0.6::DOUBLE}}),
    list_transform(list_filter(map_entries(attrs), lambda e: e.key NOT IN ('id', 'class', 'style') AND NOT {_DYNAMIC.format(x='e.value')}), lambda e: {{'s': tag || '[' || e.key || '="' || e.value || '"]', 'c': 0.5::DOUBLE}})))) AS x FROM nodes))"""
_COUNTED = "(SELECT tag, selector, confidence, count(*) AS n FROM cand {where} GROUP BY ALL)"
_CONTEXT = """, ctx AS (SELECT unnest(list_filter([ptag || coalesce('.' || pclass, '') || ' > ' || tag, before || ' + ' || tag], lambda s: s IS NOT NULL)) AS selector FROM (
  SELECT n.tag, lag(n.tag) OVER (PARTITION BY n.page_id, n.parent_id ORDER BY n.node_id) AS before, p.tag AS ptag, p.attrs['class'] AS pclass FROM nodes n JOIN nodes p ON p.page_id = n.page_id AND p.node_id = n.parent_id))"""
_PATHS = """, paths AS (
  SELECT page_id, node_id, '' AS css, '/' AS xpath FROM nodes WHERE parent_id = -1
  UNION ALL
  SELECT n.page_id, n.node_id, CASE WHEN n.attrs['id'] IS NOT NULL THEN '#' || n.attrs['id'] ELSE CASE WHEN p.css = '' THEN '' ELSE p.css || ' > ' END || n.tag || CASE WHEN n.nth > 1 THEN ':nth-of-type(' || n.nth || ')' ELSE '' END END,
    CASE WHEN n.attrs['id'] IS NOT NULL THEN '//*[@id=''' || n.attrs['id'] || ''']' ELSE p.xpath || '/' || n.tag || CASE WHEN n.nth > 1 THEN '[' || n.nth || ']' ELSE '' END END
  FROM nodes n JOIN paths p ON p.page_id = n.page_id AND p.node_id = n.parent_id)"""
_UP = """, up AS (SELECT page_id, node_id, parent_id AS anc FROM nodes WHERE parent_id >= 0 UNION ALL SELECT up.page_id, up.node_id, n.parent_id FROM up JOIN nodes n ON n.page_id = up.page_id AND n.node_id = up.anc WHERE n.parent_id >= 0),
  whole AS (SELECT page_id, anc, string_agg(text, '' ORDER BY node_id) AS text FROM (SELECT page_id, anc, node_id, (SELECT text FROM nodes n WHERE n.page_id = up.page_id AND n.node_id = up.node_id) AS text FROM up UNION ALL SELECT page_id, node_id, node_id, text FROM nodes) GROUP BY ALL)"""
_XP = {"own": ("{}", "descendant-or-self::{x}"), "below": ("{} > p::text", "descendant-or-self::{x}/p/text()"), "inside": ("article {}", "descendant-or-self::article/descendant-or-self::*/{x}"),
       "beside": ("nav + {}::attr(class)", "descendant-or-self::nav/following-sibling::*[position() = 1]/self::{x}/@class"), "after": ("nav ~ {}", "descendant-or-self::nav/following-sibling::{x}")}
_XP_ONE = "regexp_replace(regexp_replace(selector, '\\.([\\w-]+)$', '[@class and contains(concat('' '', normalize-space(@class), '' ''), '' \\1 '')]'), '\\[([\\w-]+)=\"([^\"]*)\"\\]$', '[@\\1 = ''\\2'']')"
_ESC = "regexp_replace({x}, '([-\\[\\](){{}}*+?.\\\\^$|#\\s&~])', '\\\\\\1', 'g')"
_OUTER = {"h1": "(?s)<h1>.*?</h1>", "footer": "(?s)<footer>.*?</footer>", "nav": "(?s)<nav>.*?</nav>", "div": "(?s)<div class=\"ad\">.*?</div>", "ul": "(?s)<ul>.*?</ul>"}
_STAB = "least(1.0, CASE WHEN len(regexp_extract_all({c}, ' > ')) > 2 THEN 0.7 ELSE 1 END * CASE WHEN len(regexp_extract_all({c}, '\\.')) > 3 THEN 0.8 ELSE 1 END * CASE WHEN contains({c}, ':nth-child') THEN 0.6 ELSE 1 END * CASE WHEN regexp_matches({c}, 'article|section|nav|header|footer|main') THEN 1.2 ELSE 1 END)"
_FEATURES = f"""feat AS (SELECT page_id, node_id, tag, {_CLASSES.format(n='nodes')} AS classes, attrs['id'] AS id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 100) AS text, list_sort(map_keys(attrs)) AS names, depth, nth FROM nodes)"""
_JACC = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"
_TOKS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"
_MD = "regexp_replace(html, '(?is)^.*?<body[^>]*>(.*?)(?:</body>.*$|$)', '\\1')"
for _p in ("(?is)<script[^>]*>.*?</script\\s*>", "(?is)<style[^>]*>.*?</style\\s*>", "(?s)<!--.*?-->"):
    _MD = f"regexp_replace({_MD}, '{_p}', '', 'g')"
for _i in range(1, 7):
    _MD = f"regexp_replace({_MD}, '(?is)<h{_i}\\b[^>]*>(.*?)</h{_i}>', chr(10) || chr(10) || '{'#' * _i} \\1' || chr(10) || chr(10), 'g')"
for _p, _r in (
    ("(?is)<a\\b[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>", "'[\\2](\\1)'"), ("(?is)</?(?:b|strong)(?:\\s[^>]*)?>", "'**'"), ("(?is)</?(?:i|em)(?:\\s[^>]*)?>", "'*'"), ("(?is)</?code(?:\\s[^>]*)?>", "'`'"),
    ("(?is)<li\\b[^>]*>", "chr(10) || '- '"), ("(?is)<br\\s*/?>", "chr(10)"), ("(?is)</?(?:p|div|ul|ol|article|section|table|tr)\\b[^>]*>", "chr(10) || chr(10)"), ("<[^>]*>", "''"), ("[ \\t]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"),
):
    _MD = f"regexp_replace({_MD}, '{_p}', {_r}, 'g')"
_MD = f"replace(replace(replace(replace(replace(replace({_MD}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"

SQL: dict[str, str | None] = {
    "sel2_xpath": NODES + _CANDIDATES + " SELECT form, replace(css, '{}', selector) AS css, replace(path, '{x}', x) AS xpath FROM (SELECT selector, " + _XP_ONE + " AS x FROM (SELECT DISTINCT selector FROM cand)), (VALUES " + ", ".join(f"('{k}', '{c}', '{x}')" for k, (c, x) in _XP.items()) + ") f(form, css, path)",
    "sel1_css": NODES + """ SELECT page_id, name, count(*) AS n FROM (
      SELECT a.page_id, 'beside' AS name FROM nodes a JOIN nodes b ON a.page_id = b.page_id AND a.parent_id = b.parent_id AND b.node_id < a.node_id AND b.tag = 'nav' WHERE a.tag = 'article'
      UNION ALL SELECT page_id, 'next' FROM (SELECT page_id, tag, lag(tag) OVER (PARTITION BY page_id, parent_id ORDER BY node_id) AS before FROM nodes) WHERE tag = 'footer' AND before = 'article'
      UNION ALL SELECT n.page_id, 'not' FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.node_id = n.parent_id WHERE (n.tag = 'div' AND NOT coalesce(list_contains(string_split(n.attrs['class'], ' '), 'ad'), false)) OR (n.tag = 'p' AND p.tag = 'article' AND n.nth > 1)
      UNION ALL SELECT page_id, unnest(list_filter([CASE WHEN i = 2 THEN 'second' END, CASE WHEN i % 2 = 1 AND ptag = 'ul' THEN 'odd' END, CASE WHEN i = k THEN 'last' END], lambda x: x IS NOT NULL)) FROM (
        SELECT n.page_id, n.tag, p.tag AS ptag, row_number() OVER w AS i, count(*) OVER (PARTITION BY n.page_id, n.parent_id) AS k FROM nodes n JOIN nodes p ON p.page_id = n.page_id AND p.node_id = n.parent_id WINDOW w AS (PARTITION BY n.page_id, n.parent_id ORDER BY n.node_id)) WHERE tag = 'li'
      UNION ALL SELECT page_id, 'holds' FROM nodes WHERE tag = 'footer' AND contains(text, 'example')) GROUP BY ALL""",
    "sel6_dispatch": NODES + """ SELECT page_id, name, pos::INT AS pos, value FROM (
      SELECT page_id, 'css' AS name, row_number() OVER (PARTITION BY page_id ORDER BY node_id) - 1 AS pos, trim(text) AS value FROM nodes WHERE tag = 'title'
      UNION ALL SELECT page_id, 'path', row_number() OVER (PARTITION BY page_id ORDER BY node_id) - 1, text FROM nodes WHERE tag = 'title'
      UNION ALL SELECT page_id, 'regex', 0, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) FROM pages
      UNION ALL SELECT a.page_id, 'link', row_number() OVER (PARTITION BY a.page_id ORDER BY a.node_id) - 1, a.attrs['href'] FROM nodes a JOIN nodes l ON l.page_id = a.page_id AND l.node_id = a.parent_id AND l.tag = 'li' AND l.nth = 1 WHERE a.tag = 'a'
      UNION ALL SELECT page_id, 'attr', 0, attrs['lang'] FROM nodes WHERE parent_id = -1 AND tag = 'html')""",
    "sel7_unique": "SELECT page_id, name, n, n = 1 AS is_unique FROM (SELECT page_id, unnest(['h1', 'li']) AS name, unnest([CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT), CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT)]) AS n FROM pages) WHERE n > 0",
    "sel8_paths": NODES + _PATHS + " SELECT page_id, node_id, css, CASE WHEN xpath = '/' THEN '//' ELSE xpath END AS xpath FROM paths",
    "sel9_similar": NODES + ", w AS (SELECT page_id, arg_min(trim(text), node_id) AS t FROM nodes WHERE tag = 'a' GROUP BY page_id), f AS (SELECT n.page_id, min(node_id) AS found FROM nodes n JOIN w ON w.page_id = n.page_id AND trim(n.text) = w.t GROUP BY n.page_id) SELECT n.page_id, n.node_id, f.found FROM f JOIN nodes x ON x.page_id = f.page_id AND x.node_id = f.found JOIN nodes n ON n.page_id = x.page_id AND n.depth = x.depth AND n.tag = x.tag AND list_sort(map_keys(n.attrs)) = list_sort(map_keys(x.attrs)) AND n.node_id <> x.node_id",
    "sel12_dicts": NODES + _UP + """ SELECT n.page_id, n.node_id, n.tag, CASE WHEN cardinality(n.attrs) = 0 THEN '{}' ELSE '{' || array_to_string(list_transform(map_entries(n.attrs), lambda e: '"' || e.key || '":"' || e.value || '"'), ',') || '}' END AS attributes, md5(trim(n.text)) AS text_md5,
      coalesce((SELECT string_agg(a.tag, '/' ORDER BY a.node_id) FROM up JOIN nodes a ON a.page_id = up.page_id AND a.node_id = up.anc WHERE up.page_id = n.page_id AND up.node_id = n.node_id) || '/', '') || n.tag AS path, p.tag AS parent_name,
      CASE WHEN p.tag IS NOT NULL THEN CASE WHEN cardinality(p.attrs) = 0 THEN '{}' ELSE '{' || array_to_string(list_transform(map_entries(p.attrs), lambda e: '"' || e.key || '":"' || e.value || '"'), ',') || '}' END END AS parent_attribs, md5(trim(p.text)) AS parent_md5,
      coalesce((SELECT string_agg(s.tag, ',' ORDER BY s.node_id) FROM nodes s WHERE s.page_id = n.page_id AND s.parent_id = n.parent_id AND s.node_id <> n.node_id AND n.parent_id >= 0), '') AS siblings,
      coalesce((SELECT string_agg(c.tag, ',' ORDER BY c.node_id) FROM nodes c WHERE c.page_id = n.page_id AND c.parent_id = n.node_id), '') AS children FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.node_id = n.parent_id""",
    "ext4_typed": NODES + " SELECT page_id, node_id, coalesce(attrs['href'], attrs['src'], trim(text)) AS url, coalesce(attrs['src'], attrs['data-src']) AS image, nullif(regexp_extract(replace(text, ',', ''), '(-?\\d+\\.?\\d*)', 1), '') AS number, trim(text) AS text FROM nodes WHERE tag IN ('a', 'li', 'h1', 'footer', 'div')",
    "gen2_context": NODES + _CONTEXT + " SELECT selector, count(*) AS n FROM ctx GROUP BY selector",
    "gen4_scored": "WITH c AS (SELECT page_id, unnest(['h1', 'p', 'ad', 'foot']) AS name, unnest(['article h1', 'article > p', 'div.ad', 'footer']) AS css, unnest([len(regexp_extract_all(html, '<h1>')), len(regexp_extract_all(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<p><b>.*', '<p>'), '<p>')), len(regexp_extract_all(html, '<div class=\"ad\">')), len(regexp_extract_all(html, '<footer>'))]) AS n FROM pages), g AS (SELECT name, css, count(*) FILTER (n > 0) / (SELECT count(*) FROM pages) AS coverage, count(*) FILTER (n = 1) / nullif(count(*) FILTER (n > 0), 0) AS precision, " + _STAB.format(c="css") + " AS stability FROM c GROUP BY ALL HAVING coverage > 0) SELECT name, css, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(stability::DOUBLE, 6) AS stability, round((coverage * precision * stability)::DOUBLE, 6) AS score FROM g",
    "gen5_scores": NODES + _CONTEXT + ", s AS (SELECT unnest([selector, 'body > article > ' || selector || ' > b:nth-child(2)']) AS css FROM (SELECT DISTINCT selector FROM ctx)), c AS (SELECT css, string_split(css, ' > ') AS parts, regexp_extract_all(css, '(\\.[a-zA-Z0-9_-]+)')[1:2] AS two FROM s) SELECT css, CAST(100 * len(regexp_extract_all(css, '#')) + 10 * len(regexp_extract_all(css, '\\.')) + 10 * len(regexp_extract_all(css, '\\[\\w+\\]')) + 10 * len(regexp_extract_all(css, ':\\w+')) + len(regexp_extract_all(css, '\\b\\w+\\b')) AS BIGINT) AS specificity, round(" + _STAB.format(c="css") + "::DOUBLE, 6) AS stability, array_to_string(list_concat(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:len(parts) - i], ' > ') || '=0.6'), list_filter(list_transform(two, lambda k: trim(regexp_replace(replace(css, k, ''), '\\s+', ' ', 'g')) || '=0.5'), lambda x: x <> '=0.5')), ';') AS loosened FROM c",
    "gen8_confidence": NODES + _CANDIDATES + ", c AS (SELECT page_id, selector, count(*) AS n FROM cand GROUP BY ALL) SELECT page_id, selector, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN contains(selector, '#') THEN 0.3 ELSE 0 END + CASE WHEN contains(selector, '.') THEN 0.1 ELSE 0 END - CASE WHEN contains(selector, 'nth-') THEN 0.2 ELSE 0 END + CASE WHEN n = 1 THEN 0.2 ELSE 0 END))::DOUBLE, 6) AS confidence FROM c",
    "gen9_stable": NODES + ", o AS (SELECT n.page_id, n.node_id, n.tag, p.html, CASE n.tag " + " ".join(f"WHEN '{k}' THEN regexp_extract(p.html, '{v}')" for k, v in _OUTER.items()) + " END AS src FROM nodes n JOIN pages p USING (page_id) WHERE n.tag IN ('h1', 'footer', 'nav', 'ul') OR (n.tag = 'div' AND n.attrs['class'] = 'ad')), q AS (SELECT *, strpos(html, src) AS pos FROM o) SELECT page_id, node_id, CASE tag WHEN 'div' THEN 'div.ad' ELSE tag END AS stable_css, CASE tag WHEN 'h1' THEN '/html/body/article/h1' WHEN 'div' THEN '/html/body/div[contains(@class, ''ad'')]' WHEN 'ul' THEN '/html/body/nav/ul' ELSE '/html/body/' || tag END AS stable_xpath, "
    + _ESC.format(x="substr(html, greatest(1, pos - 20)::INT, least(20, pos - 1)::INT)") + " || '\\s*(' || " + _ESC.format(x="src") + " || ')' || CASE WHEN pos + length(src) > length(html) THEN '' ELSE '\\s*' || " + _ESC.format(x="substr(html, (pos + length(src))::INT, 20)") + " END AS regex FROM q",
    "gen11_fallbacks": NODES + _CANDIDATES + " SELECT tag, array_to_string(list(selector ORDER BY confidence DESC, n DESC, selector)[1:3], ' | ') AS fallbacks FROM " + _COUNTED.format(where="WHERE tag IN ('div', 'html', 'meta')") + " GROUP BY tag",
    "gen13_describe": NODES + ", s AS (SELECT page_id, node_id, tag, lower(text) AS t, lower(array_to_string(map_values(attrs), ' ')) AS a FROM nodes) SELECT page_id, node_id, round((CASE WHEN regexp_matches(t, 'the|title') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(a, 'the|title') THEN 0.5 ELSE 0 END + CASE WHEN tag IN ('article', 'section', 'main', 'header', 'footer', 'nav', 'aside', 'h1', 'h2', 'h3') THEN 0.5 ELSE 0 END + CASE WHEN trim(t) <> '' THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS score FROM s WHERE regexp_matches(t, 'the|title') OR regexp_matches(a, 'the|title')",
    "sup11_described": NODES + _PATHS + ", s AS (SELECT page_id, node_id, tag, lower(text) AS t, lower(array_to_string(map_values(attrs), ' ')) AS a FROM nodes), c AS (SELECT page_id, node_id, CASE WHEN regexp_matches(t, 'the|title') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(a, 'the|title') THEN 0.5 ELSE 0 END + CASE WHEN tag IN ('article', 'section', 'main', 'header', 'footer', 'nav', 'aside', 'h1', 'h2', 'h3') THEN 0.5 ELSE 0 END + CASE WHEN trim(t) <> '' THEN 0.5 ELSE 0 END AS score FROM s WHERE regexp_matches(t, 'the|title') OR regexp_matches(a, 'the|title')), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, node_id) AS place FROM c) SELECT page_id, place::INT AS place, node_id, score::DOUBLE AS score, css FROM r JOIN paths USING (page_id, node_id) WHERE place <= 3",
    "rep4_signatures": NODES + f", sig AS (SELECT page_id, node_id, tag, CASE WHEN text = '' THEN '' ELSE md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) END AS h, list_filter(map_entries(attrs), lambda e: NOT {_DYNAMIC.format(x='e.value')}) AS a FROM nodes) SELECT o.page_id, o.node_id AS old_id, min(n.node_id) AS new_id FROM sig o JOIN sig n ON n.page_id = o.page_id AND n.tag = o.tag AND n.h = o.h WHERE len(o.a) = 0 OR len(list_filter(o.a, lambda e: list_contains(n.a, e))) / len(o.a) >= 0.5 GROUP BY ALL",
    "rep5_loosened": NODES + """ SELECT page_id, 'body > article.story > div.gone > h1' AS broken, 2 AS place, 'body' AS css, 0.6::DOUBLE AS confidence, count(*)::INT AS n FROM nodes WHERE tag = 'body' GROUP BY page_id
      UNION ALL SELECT page_id, 'html > body > nav.menu > ul.gone > li', unnest([2, 3]), unnest(['html > body', 'html']), 0.6, 1 FROM pages
      UNION ALL SELECT page_id, 'body > div.ad.gone', unnest([0, 2]), unnest(['body', 'body > div.ad']), unnest([0.6, 0.5]), unnest([1, count(*) FILTER (tag = 'div' AND list_contains(string_split(attrs['class'], ' '), 'ad'))]) FROM nodes GROUP BY page_id""",
    "rep6_rerank": NODES + _CANDIDATES + ", c AS (SELECT page_id, selector, max(confidence) AS s FROM cand GROUP BY ALL) SELECT a.page_id, a.selector, round(CASE WHEN b.selector IS NOT NULL THEN a.s * 1.2 ELSE a.s * 0.3 END::DOUBLE, 6) AS score FROM c a LEFT JOIN c b ON b.page_id = a.page_id + 1 AND b.selector = a.selector",
    "rep8_structure": NODES + ", g AS (SELECT page_id, count(*) AS n, avg(depth) AS depth_mean, stddev_pop(depth) AS depth_std, max(depth) AS depth_max, md5(string_agg(tag || ':' || children, '|' ORDER BY node_id) FILTER (node_id < 100)) AS dom_hash, count(*) FILTER (parent_id >= 0) AS below, sum(len(map_keys(attrs))) FILTER (parent_id >= 0) AS named, ["
    + ", ".join(f"count(*) FILTER (parent_id >= 0 AND tag = '{t}')" for t in H.VECTOR_TAGS) + "] AS tags, [" + ", ".join(f"coalesce(sum(len(list_filter(map_keys(attrs), lambda k: contains(k, '{a}')))) FILTER (parent_id >= 0), 0)::BIGINT" for a in H.VECTOR_ATTRS)
    + "] AS names FROM nodes GROUP BY page_id), r AS (SELECT *, list_concat(list_concat(list_transform(tags, lambda t: t / greatest(below, 1)), [depth_mean, depth_std, depth_max::DOUBLE]), list_transform(names, lambda t: t / greatest(named, 1))) AS raw FROM g) SELECT page_id, n, round(depth_mean, 6) AS depth_mean, round(depth_std, 6) AS depth_std, depth_max, dom_hash, array_to_string(list_transform(raw, lambda x: printf('%.6f', x / sqrt(list_sum(list_transform(raw, lambda y: y * y))))), ' ') AS vector FROM r",
    "sup4_heal": "SELECT page_id, unnest(['ad', 'kept', 'menu', 'lost']) AS name, unnest(['div.ad', 'article > h1', 'nav', NULL]) AS css, unnest([1, 1, 1, 0])::INT AS healed FROM pages",
    "sup5_candidates": NODES + _UP + """, f AS (SELECT n.page_id, n.node_id, EXISTS (SELECT 1 FROM up JOIN nodes d ON d.page_id = up.page_id AND d.node_id = up.node_id WHERE up.page_id = n.page_id AND up.anc = n.node_id AND d.tag = 'a') AS link,
        EXISTS (SELECT 1 FROM up JOIN nodes d ON d.page_id = up.page_id AND d.node_id = up.node_id WHERE up.page_id = n.page_id AND up.anc = n.node_id AND d.tag = 'img') AS image, regexp_matches(w.text, '\\d') AS digit FROM nodes n JOIN whole w ON w.page_id = n.page_id AND w.anc = n.node_id WHERE n.tag IN ('li', 'div', 'nav')),
      g AS (SELECT page_id, count(*)::INT AS text, count(*) FILTER (link)::INT AS link, count(*) FILTER (image)::INT AS image, count(*) FILTER (digit)::INT AS digits FROM f GROUP BY page_id)
      SELECT page_id, unnest(['text', 'link', 'image', 'number']) AS data_type, unnest([text, link, image, CASE WHEN digits > 0 THEN digits ELSE text END]) AS n FROM g""",
    "sup6_top": NODES + _CANDIDATES + ", t AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, selector) AS r FROM " + _COUNTED.format(where="") + ") SELECT * FROM (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY confidence DESC, n DESC, selector)::INT AS place, selector, confidence, n FROM t WHERE r <= 10) WHERE place <= 5",
    "sup7_repairs": None,
    "sup8_adapt": NODES + _PATHS + " SELECT p.page_id, p.css AS path, p.css AS adapted FROM paths p JOIN (SELECT page_id, max(node_id) AS node_id FROM nodes WHERE tag = 'p' GROUP BY page_id) l USING (page_id, node_id)",
    "sup15_features": NODES + " SELECT tag, count(*) AS n, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum(len(map_keys(attrs))) AS BIGINT) AS attributes FROM nodes GROUP BY tag",
    "conv2_markdown": f"SELECT page_id, md5(trim({_MD}, chr(10) || ' ')) AS markdown_md5 FROM pages",
}
QUERIES = {name: globals()[name] for name in SQL}
