"""Queries of selector learning and of the smaller crawl, scoring and JSON operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import crawl as C
from docloom.operators import dedup as D
from docloom.operators import html as H
from docloom.operators import learning as L
from docloom.operators import monitoring as M
from docloom.operators import records as R
from docloom.plans import base
from docloom.operators import tables as X
from docloom.plans.record_queries import _SCORED, scored
from docloom.plans.text_queries import SQL as TEXT


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def inf10_regex(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.concat(F.lit("item-"), "p_type", F.lit("-"), "p_brand", F.lit(".html")).alias("s"), F.when(F.col("p_brand").endswith("1"), "url").when(F.col("p_brand").endswith("2"), "number").alias("kind"))
    return L.validation_regex(p, "p_brand", "s", "kind")


def inf19_groups(spark, sf_dir):
    """Greedy groups of benchmark items: an item joins the first that is no member and whose cosine over a hundred terms is over 0.7."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = L.cosine_pairs(L.tfidf(b, "item_id", "text", 100), "item_id", 0.7)
    return D.first_seen(pairs, b.select("item_id").distinct()).select(F.col("k").alias("item_id"), F.coalesce("duplicate_of", "k").alias("first"))


def d19_ttl(spark, sf_dir):
    """URLs that were not let through within 24 hours before."""
    e = base.derived(spark, sf_dir, base.CRAWL).select("url", "ts", "event_id")
    return M.let_through(e, "url", "event_id", ttl=86_400).select("url", F.unix_micros("ts").alias("us"), "event_id")


def inf19_nearest(spark, sf_dir):
    t = L.tfidf(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return L.nearest_example(t, t, "item_id").select("query", "example", F.round("similarity", 6).alias("similarity"))


def _names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))


def d13_fuzzy(spark, sf_dir):
    return D.fuzzy_first_seen(_names(spark, sf_dir), "p_partkey", "name").withColumn("similarity", F.round("similarity", 6))


def gen7_candidates(spark, sf_dir):
    """The candidates of each page that are not much like a better one."""
    c = H.candidates(H.nodes(_pages(spark, sf_dir))).select("page_id", "selector", (-F.col("confidence")).alias("worse")).distinct()
    return L.fuzzy_unique(c, "page_id", "selector", ["worse", "selector"])


def sup9_classes(spark, sf_dir):
    s = spark.createDataFrame([("btn-main", ["x", "btn-big"]), ("item", ["items", "y"]), ("a", ["b"]), ("q", ["q", "q-1"])], "w string, cs array<string>")
    return s.select("w", L.similar_class(F.col("w"), F.col("cs")).alias("found"), L.tags_compatible(F.lit("div"), F.lit("section")).alias("tags"))


def enr3_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = F.concat(F.lit('{"itemListElement":[{"result":{"name":"N'), F.col("event_id") % 10, F.lit('"}}],"pages":{"-1":{"title":"no"},"'), F.col("user_id"), F.lit('":{"title":"T'), F.col("user_id"), F.lit('"}}}'))
    parsed = F.from_json(j, "itemListElement array<struct<result struct<name string>>>, pages map<string,struct<title string>>")
    page = F.get(F.map_values(F.map_filter(parsed["pages"], lambda k, _: k != "-1")), F.lit(0))
    return e.select("event_id", F.get(parsed["itemListElement"], F.lit(0))["result"]["name"].alias("name"), page["title"].alias("title"))


def sup18_pending(spark, sf_dir):
    return C.pending(base.derived(spark, sf_dir, base.TASKS), 40).select("task_id", "priority")


def scl2_cooldown(spark, sf_dir):
    e = base.derived(spark, sf_dir, base.CRAWL).filter("response_time > 6")
    return M.cooldown(e, "crawl_id", hold=7200).groupBy("crawl_id").agg(F.count("*").alias("n"))


def qs16_overalls(spark, sf_dir):
    s = scored(spark, sf_dir)
    c = {k: F.col(k) for k in ("completeness", "accuracy", "consistency", "uniqueness", "timeliness")}
    b = R.overall(c, R.WEIGHTS_C)
    some = {k: v for k, v in c.items() if k != "timeliness"}
    return s.select("id", F.round(b, 9).alias("all_c"), F.round(R.overall(some, R.WEIGHTS_C), 9).alias("without_time"), F.round(R.boosted(b, F.lit(3)), 9).alias("boosted"), F.round((c["completeness"] + c["consistency"] + c["accuracy"]) / 3, 9).alias("mean_d"))


def qs20_report(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("overall", F.round("overall", 9))
    return s.select("id", R.report_text().alias("report"))


def qs24_recommendations(spark, sf_dir):
    return R.recommendations(R.summary(scored(spark, sf_dir))).select(F.array_join("recommendations", ";").alias("advice"))


def qs9_reference(spark, sf_dir):
    """Against the first ten records."""
    r = base.derived(spark, sf_dir, base.RECORDS)
    c = R.consistency_reference(r, r.orderBy("id").limit(10), {"contact_email": "@", "scraped_date": r"^\d{4}-\d{2}-\d{2}$"})
    return c.select("id", F.round("consistency", 6).alias("consistency"))


_E, _T = f"({base.CRAWL})", f"({base.TASKS})"
_W = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "timeliness": 0.15, "uniqueness": 0.10}
_ALL = "(" + " + ".join(f"{k} * {w}" for k, w in _W.items()) + ") / 0.95"
_SOME = "(" + " + ".join(f"{k} * {w}" for k, w in _W.items() if k != "timeliness") + ") / 0.8"

_LIT = "regexp_replace({x}, '([.+*?^${{}}()|\\[\\]\\\\-])', '\\\\\\1', 'g')"

SQL: dict[str, str | None] = {
    "inf10_regex": "SELECT a.p_brand, CASE WHEN suffix(a.p_brand, '1') THEN '^https?://[^\\s]+$' WHEN suffix(a.p_brand, '2') THEN '^-?\\d+(\\.\\d+)?$' WHEN n >= 3 THEN '^' || " + _LIT.format(x="prefix") + " || '.*' || " + _LIT.format(x="suffix") + " || '$' END AS regex FROM (" + TEXT["txt_common_affix"] + ") a JOIN (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand) USING (p_brand)",
    "inf19_groups": r"""WITH RECURSIVE t AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM t GROUP BY token ORDER BY sum(tf) DESC, token LIMIT 100),
      w AS (SELECT item_id, token, tf * (ln((1 + (SELECT count(DISTINCT item_id) FROM benchmark)) / (1 + df)) + 1) AS w FROM t JOIN d USING (token)), u AS MATERIALIZED (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w),
      p AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b FROM u a JOIN u b ON a.token = b.token AND a.item_id < b.item_id GROUP BY ALL HAVING sum(a.w * b.w) > 0.7), k AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM (SELECT DISTINCT item_id FROM benchmark)), n AS MATERIALIZED (SELECT k.i, k.item_id, list(p.a) AS near FROM k LEFT JOIN p ON p.b = k.item_id GROUP BY ALL),
      g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS BIGINT) AS first UNION ALL SELECT i, CASE WHEN f IS NULL THEN list_append(kept, item_id) ELSE kept END, item_id, coalesce(f, item_id) FROM (SELECT n.i, n.item_id, g.kept, list_min(list_filter(g.kept, lambda x: list_contains(n.near, x))) AS f FROM g JOIN n ON n.i = g.i + 1)) SELECT item_id, first FROM g WHERE item_id IS NOT NULL""",
    "d19_ttl": f"WITH RECURSIVE e AS (SELECT url, epoch_us(ts) AS us, min(event_id) AS event_id FROM {_E} GROUP BY ALL), s AS (SELECT url, min(us) AS us FROM e GROUP BY url UNION ALL SELECT s.url, (SELECT min(e.us) FROM e WHERE e.url = s.url AND e.us >= s.us + 86400000000) FROM s WHERE s.us IS NOT NULL) SELECT s.url, s.us, e.event_id FROM s JOIN e USING (url, us)",
    "inf19_nearest": r"""WITH t AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM t GROUP BY token), w AS (SELECT item_id, token, tf * (ln((1 + (SELECT count(DISTINCT item_id) FROM benchmark)) / (1 + df)) + 1) AS w FROM t JOIN d USING (token)),
      u AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w), s AS (SELECT a.item_id AS query, b.item_id AS example, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.token = b.token AND a.item_id <> b.item_id GROUP BY ALL) SELECT query, arg_max(example, (s, -example)) AS example, round(max(s), 6) AS similarity FROM s GROUP BY query""",
    "d13_fuzzy": None,
    "gen7_candidates": None,
    "sup9_classes": "SELECT * FROM (VALUES ('btn-main', 'btn-big', true), ('item', 'items', true), ('a', NULL, true), ('q', 'q', true)) t(w, found, tags)",
    "enr3_json": "SELECT event_id, 'N' || (event_id % 10) AS name, 'T' || user_id AS title FROM events",
    "sup18_pending": f"SELECT task_id, priority FROM {_T} WHERE status = 'pending' ORDER BY priority, created_at, task_id LIMIT 40",
    "scl2_cooldown": f"WITH RECURSIVE t AS (SELECT crawl_id, epoch_us(ts) AS t FROM {_E} WHERE response_time > 6), s AS (SELECT crawl_id, min(t) AS sent_at FROM t GROUP BY crawl_id UNION ALL SELECT s.crawl_id, (SELECT min(t.t) FROM t WHERE t.crawl_id = s.crawl_id AND t.t >= s.sent_at + 7200000000) FROM s WHERE s.sent_at IS NOT NULL) SELECT crawl_id, count(*) AS n FROM s WHERE sent_at IS NOT NULL GROUP BY crawl_id",
    "qs16_overalls": f"SELECT id, round(({_ALL})::DOUBLE, 9) AS all_c, round(({_SOME})::DOUBLE, 9) AS without_time, round(least(1.0, {_ALL} + 0.06)::DOUBLE, 9) AS boosted, round(((completeness + consistency + accuracy) / 3)::DOUBLE, 9) AS mean_d FROM {_SCORED}",
    "qs20_report": f"SELECT id, id || ': ' || printf('%.3f', round(overall, 9)) || ' (' || CASE WHEN round(overall, 9) >= 0.9 THEN 'A' WHEN round(overall, 9) >= 0.8 THEN 'B' WHEN round(overall, 9) >= 0.7 THEN 'C' WHEN round(overall, 9) >= 0.6 THEN 'D' ELSE 'F' END || ')' AS report FROM {_SCORED}",
    "qs24_recommendations": f"SELECT array_to_string(list_filter([CASE WHEN avg(overall) < 0.7 THEN 'Improve data quality at the source' END, CASE WHEN avg(CASE WHEN is_duplicate THEN 1 ELSE 0 END) > 0.1 THEN 'Tighten deduplication' END, CASE WHEN min(overall) < 0.3 THEN 'Reject records of the lowest level' END], lambda x: x IS NOT NULL), ';') AS advice FROM {_SCORED}",
    "qs9_reference": f"WITH r AS (SELECT id, contains(contact_email, '@') AS a, regexp_matches(scraped_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS d FROM ({base.RECORDS})), f AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (d) AS nd, count(*) AS n FROM (SELECT a, d FROM r ORDER BY id LIMIT 10)) SELECT id, round((CASE WHEN a THEN na ELSE n - na END / n + CASE WHEN d THEN nd ELSE n - nd END / n) / 2, 6) AS consistency FROM r, f",
}
QUERIES = {name: globals()[name] for name in SQL}
