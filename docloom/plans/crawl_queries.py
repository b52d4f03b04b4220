"""Queries of crawl and politeness operators, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import crawl as C
from docloom.operators import dedup as D
from docloom.operators import politeness as P
from docloom.plans import base
from docloom.plans.text_queries import _CANON, _SPLIT

def _as_of():
    return F.expr(base.AS_OF)

ROBOTS = "User-agent: *\nUser-agent: bot # comment\nAllow: /p/1\nDisallow: /p/\nDisallow: /*.json$\nCrawl-delay: 2.5\nRequest-rate: 3/10\nSitemap: http://x/s.xml\nnonsense"


def _tasks(spark, sf_dir):
    t = base.derived(spark, sf_dir, base.TASKS)
    return t.withColumn("score", C.priority_score(F.col("priority"), F.col("depth"), F.col("created_at"), _as_of()))


def _crawl(spark, sf_dir):
    return base.derived(spark, sf_dir, base.CRAWL)


def crw1_fingerprint(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", C.fingerprint(F.col("url"), F.lit("GET"), F.lit(""), F.col("domain")).alias("fingerprint"))


def crw3_enqueue(spark, sf_dir):
    return D.enqueue(_tasks(spark, sf_dir).withColumn("fp", U.url_hash(F.col("url"))), "fp", "task_id", "dont_filter").select("task_id")


def crw4_dequeue(spark, sf_dir):
    t = _tasks(spark, sf_dir).withColumn("neg", -F.col("priority"))
    return C.dequeue(t, "neg", "task_id", 100).select("task_id", "priority")


def crw6_offsite(spark, sf_dir):
    domains = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("h"), "n_nationkey", F.lit(".example.com")).alias("d"))
    return C.split_offsite(_tasks(spark, sf_dir), "url", domains, "d").groupBy("allowed").agg(F.count("*").alias("n"))


def crw7_retries(spark, sf_dir):
    r = _crawl(spark, sf_dir).withColumns({"retry_count": F.col("depth"), "priority": F.lit(5)})
    return C.retries(r, 2).select("event_id", F.col("priority").cast("long").alias("priority"), F.col("retry_count").cast("long").alias("retry_count"))


def udf9_retries(spark, sf_dir):
    """A spider's own idea of what is blocked, and of what a request to try again gets."""
    r = _crawl(spark, sf_dir).withColumns({"retry_count": F.col("depth"), "priority": F.lit(5)})
    slow = (F.col("status_code") == 404) | (F.col("response_time") > 9)
    out = C.retries(r, 3, is_blocked=slow, again={"proxy": F.concat(F.lit("next-"), "proxy"), "priority": F.col("priority") + 2})
    return out.select("event_id", F.col("priority").cast("long").alias("priority"), F.col("retry_count").cast("long").alias("retry_count"), "proxy")


def dst1_priority(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", F.round("score", 4).alias("score"))


def dst2_pop(spark, sf_dir):
    return C.dequeue(_tasks(spark, sf_dir).filter("status = 'pending'"), "score", "task_id", 50).select("task_id")


def dst3_slots(spark, sf_dir):
    return C.slots(_tasks(spark, sf_dir), "domain", "score", "task_id", 1.5).select("task_id", "slot")


def _ring(spark, sf_dir):
    return C.ring(base.derived(spark, sf_dir, base.NODES), "node_id")


def dst4_route(spark, sf_dir):
    return C.route(_tasks(spark, sf_dir).select("task_id", "url"), "url", _ring(spark, sf_dir)).select("task_id", "node")


def dst5_successors(spark, sf_dir):
    keys = _tasks(spark, sf_dir).select("domain").distinct()
    return C.successors(keys, "domain", _ring(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def dst6_least_loaded(spark, sf_dir):
    keys = _tasks(spark, sf_dir).select("domain").distinct()
    return C.least_loaded(C.successors(keys, "domain", _ring(spark, sf_dir)), "domain", base.derived(spark, sf_dir, base.NODES))


def dst8_alive(spark, sf_dir):
    return C.alive(base.derived(spark, sf_dir, base.NODES), _as_of()).select("node_id", "alive")


def dst9_backoff(spark, sf_dir):
    t = _tasks(spark, sf_dir).filter("status = 'failed' AND retry_count < 4")
    return t.select("task_id", C.backoff(F.col("retry_count")).alias("delay"))


def dst10_stats(spark, sf_dir):
    return _tasks(spark, sf_dir).groupBy("priority").pivot("status", ["failed", "pending", "running"]).count().na.fill(0)


def crw10_levels(spark, sf_dir):
    e = _crawl(spark, sf_dir)
    links = e.select(F.col("url").alias("src"), F.concat(F.lit("http://h"), F.col("bytes") % 30, F.lit(".example.com/p/"), F.col("bytes") % 50).alias("dst")).distinct()
    seeds = spark.createDataFrame([("http://h1.example.com/p/1",), ("http://h2.example.com/p/2",)], "url string")
    return C.levels(e, "url", links, seeds, 3).groupBy("depth").agg(F.count("*").alias("n"))


def _robots(spark):
    return P.robots(spark.createDataFrame([("x", ROBOTS)], "host string, robots string"), "robots")


def pol2_robots(spark, sf_dir):
    r = _robots(spark)
    return r.select("host", F.array_join("user_agents", ",").alias("agents"), F.array_join("disallowed_paths", ",").alias("disallowed"), F.array_join("allowed_paths", ",").alias("allowed"), "crawl_delay", "request_rate", F.array_join("sitemaps", ",").alias("sitemaps"))


def pol3_permission(spark, sf_dir):
    u = _crawl(spark, sf_dir).select("url").distinct().crossJoin(F.broadcast(_robots(spark).select("allowed_paths", "disallowed_paths")))
    path = U.path(F.col("url"))
    return u.select("url", P.is_allowed(path, F.col("allowed_paths"), F.col("disallowed_paths")).alias("allowed"), P.wildcard_denies(F.concat(path, F.lit(".json")), F.col("disallowed_paths")).alias("denied_json"))


def pol4_token_bucket(spark, sf_dir):
    r = _crawl(spark, sf_dir).withColumn("s", F.col("event_id").cast("double"))
    return P.token_bucket(r, "crawl_id", "s", ["s"], 0.05, 3.0).select("crawl_id", "granted", F.round("waited", 4).alias("waited"))


def pol5_ema(spark, sf_dir):
    return P.ema(_crawl(spark, sf_dir), "crawl_id", "response_time", ["event_id"]).withColumn("ema", F.round("ema", 6))


def pol6_throttle(spark, sf_dir):
    return P.throttle(_crawl(spark, sf_dir), "crawl_id", ["event_id"]).withColumn("rate", F.round("rate", 6))


def pol10_delay(spark, sf_dir):
    t = P.throttle(_crawl(spark, sf_dir), "crawl_id", ["event_id"]).crossJoin(F.broadcast(_robots(spark).select("crawl_delay")))
    return t.select("crawl_id", F.round(P.required_delay(F.col("backoff"), F.lit(0.0), F.col("crawl_delay"), F.col("rate")), 6).alias("delay"))


_T = f"(SELECT *, priority * 1000 + depth * 100 - (epoch_us({base.AS_OF}) / 1e6 - epoch_us(created_at) / 1e6) / 3600 AS score FROM ({base.TASKS}))"
_E = f"({base.CRAWL})"
_RING = f"(SELECT md5(node || ':' || i) AS h, node FROM (SELECT node_id AS node, unnest(range(100)) AS i FROM ({base.NODES})))"
_RANKED = f"(SELECT domain, node, row_number() OVER (PARTITION BY domain ORDER BY w, h) - 1 AS rank FROM (SELECT domain, node, min(w) AS w, arg_min(h, (w, h)) AS h FROM (SELECT domain, node, h, CASE WHEN h >= md5(domain) THEN 0 ELSE 1 END AS w FROM (SELECT DISTINCT domain FROM {_T}) CROSS JOIN {_RING}) GROUP BY domain, node))"
_DELAY = re.search(r"Crawl-delay: ([\d.]+)", ROBOTS)[1]
_THROTTLE = f"""WITH RECURSIVE m AS (SELECT crawl_id, list(status_code ORDER BY event_id) AS xs FROM {_E} GROUP BY crawl_id), f AS (
  SELECT crawl_id, CAST(0 AS BIGINT) AS i, 0::INT AS errors, 1.0::DOUBLE AS rate FROM m
  UNION ALL SELECT f.crawl_id, f.i + 1, CASE WHEN m.xs[f.i + 1] >= 400 THEN f.errors + 1 ELSE 0 END, greatest(0.1, least(10.0, f.rate * CASE WHEN m.xs[f.i + 1] IN (429, 503) THEN 0.5 WHEN m.xs[f.i + 1] >= 400 THEN 0.9 ELSE 1.1 END))
  FROM f JOIN m USING (crawl_id) WHERE f.i < len(m.xs)
), last AS (SELECT crawl_id, errors, CASE WHEN errors >= 10 THEN least(300.0, 2.0 ** (errors - 3)) WHEN errors >= 3 THEN least(60.0, 2.0 ** errors) ELSE 0.0 END::DOUBLE AS backoff, rate FROM f JOIN m USING (crawl_id) WHERE i = len(xs))"""
_BLOCKED = ", ".join(map(str, C.BLOCKED))

SQL: dict[str, str | None] = {
    "crw1_fingerprint": f"SELECT task_id, sha1('{{\"body\":\"\",\"method\":\"GET\",\"sid\":\"' || domain || '\",\"url\":\"' || {_CANON} || '\"}}') AS fingerprint FROM {_SPLIT.format(t=_T)}",
    "crw3_enqueue": f"SELECT task_id FROM (SELECT task_id, dont_filter, row_number() OVER (PARTITION BY {_CANON} ORDER BY task_id) AS r FROM {_SPLIT.format(t=_T)}) WHERE r = 1 OR dont_filter",
    "crw4_dequeue": f"SELECT task_id, priority FROM {_T} ORDER BY priority DESC, task_id LIMIT 100",
    "crw6_offsite": f"SELECT d IS NOT NULL AS allowed, count(*) AS n FROM {_T} LEFT JOIN (SELECT 'h' || n_nationkey AS d FROM nation) ON d = domain GROUP BY 1",
    "crw7_retries": f"SELECT event_id, CAST(4 AS BIGINT) AS priority, CAST(depth + 1 AS BIGINT) AS retry_count FROM {_E} WHERE status_code IN ({_BLOCKED}) AND depth < 2",
    "udf9_retries": f"SELECT event_id, CAST(7 AS BIGINT) AS priority, CAST(depth + 1 AS BIGINT) AS retry_count, 'next-' || proxy AS proxy FROM {_E} WHERE (status_code = 404 OR response_time > 9) AND depth < 3",
    "dst1_priority": f"SELECT task_id, round(score, 4) AS score FROM {_T}",
    "dst2_pop": f"SELECT task_id FROM {_T} WHERE status = 'pending' ORDER BY score, task_id LIMIT 50",
    "dst3_slots": f"SELECT task_id, (row_number() OVER (PARTITION BY domain ORDER BY score, task_id) - 1) * 1.5::DOUBLE AS slot FROM {_T}",
    "dst4_route": f"SELECT task_id, coalesce((SELECT arg_min(node, h) FROM {_RING} WHERE h >= md5(url)), (SELECT arg_min(node, h) FROM {_RING})) AS node FROM {_T}",
    "dst5_successors": f"SELECT domain, rank, node FROM {_RANKED} WHERE rank < 3",
    "dst6_least_loaded": f"SELECT domain, arg_min(node, (current_tasks / max_tasks, rank)) AS node FROM {_RANKED} JOIN ({base.NODES}) ON node = node_id WHERE rank < 3 GROUP BY domain",
    "dst8_alive": f"SELECT node_id, epoch({base.AS_OF}) - epoch(last_heartbeat) <= 90 AS alive FROM ({base.NODES})",
    "dst9_backoff": f"SELECT task_id, least(300.0, pow(2.0, retry_count))::DOUBLE AS delay FROM {_T} WHERE status = 'failed' AND retry_count < 4",
    "dst10_stats": f"SELECT priority, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running FROM {_T} GROUP BY priority",
    "crw10_levels": f"WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT url AS src, 'http://h' || (bytes % 30) || '.example.com/p/' || (bytes % 50) AS dst FROM {_E}), b AS (SELECT * FROM (VALUES ('http://h1.example.com/p/1', 0), ('http://h2.example.com/p/2', 0)) s(url, d) UNION SELECT l.dst, b.d + 1 FROM b JOIN l ON l.src = b.url WHERE b.d < 3) SELECT depth, count(*) AS n FROM (SELECT url, CAST(min(d) AS INT) AS depth FROM b GROUP BY url) GROUP BY depth",
    "pol2_robots": "SELECT 'x' AS host, '*,bot' AS agents, '/p/,/*.json$' AS disallowed, '/p/1' AS allowed, 2.5::DOUBLE AS crawl_delay, 0.3::DOUBLE AS request_rate, 'http://x/s.xml' AS sitemaps",
    "pol3_permission": f"SELECT DISTINCT url, starts_with(p, '/p/1') OR NOT starts_with(p, '/p/') AS allowed, true AS denied_json FROM (SELECT url, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS p FROM {_E})",
    # a token is 20 seconds of refill, a full bucket 60: whole numbers, where sums of 0.05 would not meet 1
    "pol4_token_bucket": f"""WITH RECURSIVE o AS (SELECT crawl_id, event_id AS s, row_number() OVER (PARTITION BY crawl_id ORDER BY event_id) AS i FROM {_E}), b AS (
  SELECT crawl_id, i, s, CAST(40 AS BIGINT) AS credit, CAST(1 AS BIGINT) AS granted, CAST(0 AS BIGINT) AS waited FROM o WHERE i = 1
  UNION ALL SELECT crawl_id, i, s, CASE WHEN c >= 20 THEN c - 20 ELSE c END, granted + CASE WHEN c >= 20 THEN 1 ELSE 0 END, waited + CASE WHEN c >= 20 THEN 0 ELSE 20 - c END
  FROM (SELECT o.crawl_id, o.i, o.s, least(60, b.credit + o.s - b.s) AS c, granted, waited FROM b JOIN o ON o.crawl_id = b.crawl_id AND o.i = b.i + 1))
SELECT crawl_id, arg_max(granted, i) AS granted, CAST(arg_max(waited, i) AS DOUBLE) AS waited FROM b GROUP BY crawl_id""",
    "pol5_ema": f"SELECT crawl_id, round(list_reduce(list(response_time ORDER BY event_id), lambda a, x: a * 0.9 + x * 0.1), 6) AS ema FROM {_E} GROUP BY crawl_id",
    "pol6_throttle": _THROTTLE + " SELECT crawl_id, CASE WHEN errors >= 10 THEN 'blocked' WHEN errors >= 3 THEN 'backoff' ELSE 'normal' END AS state, errors, backoff, round(rate, 6) AS rate FROM last",
    "pol10_delay": _THROTTLE + " SELECT crawl_id, round(CASE WHEN backoff > 0 THEN backoff ELSE " + _DELAY + " END, 6) AS delay FROM last",
}
QUERIES = {name: globals()[name] for name in SQL}
