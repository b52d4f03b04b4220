"""Queries of monitoring operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import monitoring as M
from docloom.plans import base

def _as_of():
    return F.expr("TIMESTAMP '2024-01-20 00:00:00'")



def _crawl(spark, sf_dir):
    return base.derived(spark, sf_dir, base.CRAWL)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_MEANS = ("avg_response_time", "min_response_time", "max_response_time", "elapsed", "success_rate", "block_rate", "failure_rate", "requests_per_second")


def mon_counters(spark, sf_dir):
    return _rounded(M.counters(_crawl(spark, sf_dir)), *_MEANS)


def mon_running(spark, sf_dir):
    r = M.running(_crawl(spark, sf_dir))
    return _rounded(r.select("event_id", "seen", "failed", "mean_so_far", "mean_of_last"), "mean_so_far", "mean_of_last")


def mon_history(spark, sf_dir):
    return M.within(_crawl(spark, sf_dir), _as_of(), 120).groupBy("crawl_id").agg(F.count("*").alias("n"))


def mon_last_n(spark, sf_dir):
    return M.bounded_history(_crawl(spark, sf_dir), "crawl_id", 10).select("crawl_id", F.col("rank").cast("long").alias("rank"), "event_id")


def mon_global(spark, sf_dir):
    return _rounded(M.summary(M.counters(_crawl(spark, sf_dir))), "avg_success_rate")


def mon_histogram(spark, sf_dir):
    return M.histogram(_crawl(spark, sf_dir))


def mon_labelled(spark, sf_dir):
    return M.labelled(_crawl(spark, sf_dir), ["crawl_id", "status_code", "proxy"])


def mon_frequencies(spark, sf_dir):
    r = _crawl(spark, sf_dir)
    return M.frequencies(r, "crawl_id", "error").select("crawl_id", F.col("error").alias("value"), "n").unionByName(M.frequencies(r, "crawl_id", "proxy").select("crawl_id", F.col("proxy").alias("value"), "n"))


def mon_alerts(spark, sf_dir):
    m = M.counters(_crawl(spark, sf_dir)).withColumns({"cpu_percent": F.lit(0), "memory_percent": F.lit(0), "status": F.lit("running")})
    out = None
    for name, rules in (("A", M.RULES_A), ("B", M.RULES_B), ("C", M.RULES_C)):
        part = M.alerts(m, rules).withColumn("list", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mon_cooldown(spark, sf_dir):
    sent = M.cooldown(_crawl(spark, sf_dir).filter("NOT success"), "crawl_id", hold=3600)
    return sent.select("crawl_id", F.unix_micros("sent_at").alias("sent_at"))


def mon_lifecycle(spark, sf_dir):
    e = _crawl(spark, sf_dir).select(F.col("url").alias("alert"), "ts", "event_id", F.when(F.col("success"), "resolved").when(F.col("blocked"), "active").otherwise("acknowledged").alias("state"))
    return M.latest(e, "alert", ["ts", "event_id"]).filter("state <> 'resolved'").select("alert", "state")


def snk_exposition(spark, sf_dir):
    return M.exposition(M.counters(_crawl(spark, sf_dir)), ["requests", "failures", "blocks"])


_C = f"({base.CRAWL})"
_COUNT = f"""(SELECT *, 100.0 * successes / requests AS success_rate, 100.0 * blocks / requests AS block_rate, 100.0 * failures / requests AS failure_rate, coalesce(requests / nullif(elapsed, 0), 0) AS requests_per_second FROM (
  SELECT crawl_id, count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, count(*) FILTER (blocked) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes, avg(response_time) AS avg_response_time,
    min(response_time) AS min_response_time, max(response_time) AS max_response_time, count(DISTINCT url) AS urls, max(depth) AS depth, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS elapsed FROM {_C} GROUP BY crawl_id))"""
_RULES = " UNION ALL ".join(f"SELECT crawl_id, '{n}' AS rule, '{s}' AS severity, '{m}' AS message, '{lst}' AS list FROM (SELECT *, 0 AS cpu_percent, 0 AS memory_percent, 'running' AS status FROM {_COUNT}) WHERE {c}" for lst, rs in (("A", M.RULES_A), ("B", M.RULES_B), ("C", M.RULES_C)) for n, c, s, m in rs)
_BOUNDS = " UNION ALL ".join(f"SELECT crawl_id, '{b}' AS le, count(*) FILTER (response_time <= {b}) AS n FROM {_C} GROUP BY crawl_id" for b in M.BUCKETS)

SQL: dict[str, str | None] = {
    "mon_counters": "SELECT crawl_id, requests, successes, failures, blocks, bytes, urls, depth, " + ", ".join(f"round({m}::DOUBLE, 6) AS {m}" for m in _MEANS) + f" FROM {_COUNT}",
    "mon_running": f"SELECT event_id, count(*) OVER w AS seen, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS BIGINT) AS failed, round(avg(response_time) OVER w, 6) AS mean_so_far, round(avg(response_time) OVER (PARTITION BY crawl_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean_of_last FROM {_C} WINDOW w AS (PARTITION BY crawl_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "mon_history": f"SELECT crawl_id, count(*) AS n FROM {_C} WHERE ts > TIMESTAMP '2024-01-19 22:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY crawl_id",
    "mon_last_n": f"SELECT crawl_id, r AS rank, event_id FROM (SELECT crawl_id, event_id, row_number() OVER (PARTITION BY crawl_id ORDER BY ts DESC, event_id DESC) AS r FROM {_C}) WHERE r <= 10",
    "mon_global": f"SELECT count(*) AS crawls, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(failures) AS BIGINT) AS failures, round(avg(success_rate)::DOUBLE, 6) AS avg_success_rate FROM {_COUNT}",
    "mon_histogram": f"{_BOUNDS} UNION ALL SELECT crawl_id, '+Inf', count(response_time) FROM {_C} GROUP BY crawl_id",
    "mon_labelled": f"SELECT crawl_id, status_code, proxy, count(*) AS n, grouping(crawl_id, status_code, proxy) AS level FROM {_C} GROUP BY ROLLUP (crawl_id, status_code, proxy)",
    "mon_frequencies": f"SELECT crawl_id, error AS value, count(*) AS n FROM {_C} WHERE error IS NOT NULL GROUP BY ALL UNION ALL SELECT crawl_id, proxy, count(*) FROM {_C} GROUP BY ALL",
    "mon_alerts": _RULES,
    "mon_cooldown": f"WITH RECURSIVE t AS (SELECT crawl_id, epoch_us(ts) AS t FROM {_C} WHERE NOT success), s AS (SELECT crawl_id, min(t) AS sent_at FROM t GROUP BY crawl_id UNION ALL SELECT s.crawl_id, (SELECT min(t.t) FROM t WHERE t.crawl_id = s.crawl_id AND t.t >= s.sent_at + 3600000000) FROM s WHERE s.sent_at IS NOT NULL) SELECT crawl_id, sent_at FROM s WHERE sent_at IS NOT NULL",
    "mon_lifecycle": f"SELECT alert, state FROM (SELECT url AS alert, CASE WHEN success THEN 'resolved' WHEN blocked THEN 'active' ELSE 'acknowledged' END AS state, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS r FROM {_C}) WHERE r = 1 AND state <> 'resolved'",
    "snk_exposition": f"SELECT 'crawl_' || m || '{{crawl_id=\"' || crawl_id || '\"}} ' || v AS line FROM (SELECT crawl_id, unnest(['requests', 'failures', 'blocks']) AS m, unnest([requests, failures, blocks]) AS v FROM {_COUNT})",
}
QUERIES = {name: globals()[name] for name in SQL}
