"""Queries of service decisions, schemas and the smaller record operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import crawl as C
from docloom.operators import extensions as X
from docloom.operators import inference as I
from docloom.operators import monitoring as M
from docloom.operators import politeness as P
from docloom.operators import records as R
from docloom.operators import service as S
from docloom.operators import tables as T
from docloom.plans import base
from docloom.plans.html_queries import SQL as HTML
from docloom.plans.tree_queries import SQL as TREE
from docloom.sources import io, stores

_E, _T, _N, _S, _R, _C = (f"({x})" for x in (base.CRAWL, base.TASKS, base.NODES, base.SESSIONS, base.RECORDS, base.COOKIES))


def _crawl(spark, sf_dir):
    return base.derived(spark, sf_dir, base.CRAWL)


def _records(spark, sf_dir):
    return base.derived(spark, sf_dir, base.RECORDS)


def _outcomes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id % 5000 AS task_id", "event_type <> 'error' AS ok", "'e' || (event_id % 4) AS error", "event_id AS at", "'n' || (event_id % 20) AS node_id")


_O = "(SELECT event_id % 5000 AS task_id, event_type <> 'error' AS ok, 'e' || (event_id % 4) AS error, event_id AS at, 'n' || (event_id % 20) AS node_id FROM events)"


def sup20_transitions(spark, sf_dir):
    t = S.transitions(base.derived(spark, sf_dir, base.TASKS), _outcomes(spark, sf_dir))
    return t.select("task_id", "status", "error", "completed_at")


def sup20_nodes(spark, sf_dir):
    return S.node_counters(_outcomes(spark, sf_dir), base.derived(spark, sf_dir, base.NODES)).select("node_id", "completed", "failed", "current_tasks")


def _robots_by_host(spark, sf_dir):
    """A robots.txt for each host, some with rules."""
    h = _crawl(spark, sf_dir).select(U.host(F.col("url")).alias("host")).distinct()
    n = F.regexp_extract("host", r"^h(\d+)", 1).cast("int")
    return P.robots(h.withColumn("robots", F.concat(F.lit("User-agent: *\nAllow: /p/1\nDisallow: /p/"), n % 10, F.lit("\nCrawl-delay: "), n % 4)), "robots")


def pol3_by_host(spark, sf_dir):
    return P.permitted(_crawl(spark, sf_dir).select("url").distinct(), _robots_by_host(spark, sf_dir)).select("url", "allowed")


_ALLOWED = "(starts_with(p, '/p/1') OR NOT starts_with(p, '/p/' || (CAST(regexp_extract(url, '://h(\\d+)', 1) AS INT) % 10)))"


def sup27_gate(spark, sf_dir):
    c = _crawl(spark, sf_dir).select("event_id", "url", "depth", (F.col("bytes") % 7 / 4.0).alias("tokens"), F.lit(0.5).alias("rate"), (F.col("bytes") % 11).alias("active"))
    p = P.permitted(c, _robots_by_host(spark, sf_dir)).withColumnRenamed("allowed", "allowed_by_robots")
    return S.gate(p, 8).select("event_id", "allowed", F.round("wait_time", 6).alias("wait_time"), "error")


def sup28_wait(spark, sf_dir):
    c = _crawl(spark, sf_dir).select("event_id", (F.col("event_id") % 13 != 0).alias("allowed_by_robots"), (100.0 + F.col("bytes") % 60).alias("backoff_until"), (F.col("bytes") % 3 == 0).alias("is_throttled"), (90.0 + F.col("bytes") % 50).alias("throttle_until"), (F.col("bytes") % 37).cast("double").alias("required_delay"))
    return S.wait_or_refuse(c, F.lit(100.0), 30.0).select("event_id", "decision", F.round("waited", 6).alias("waited"))


def sup22_system_alerts(spark, sf_dir):
    m = _crawl(spark, sf_dir).select("event_id", (F.col("bytes") % 101).alias("cpu_percent"), (F.col("bytes") * 7 % 101).alias("memory_percent"))
    return M.alerts(m, M.RULES_SYSTEM, "event_id").select("event_id", "rule", "severity")


def _per_crawl(spark, sf_dir):
    c = M.counters(_crawl(spark, sf_dir))
    n = F.regexp_extract("crawl_id", r"(\d+)", 1).cast("int")
    return c.withColumns({"cpu_percent": n * 11, "memory_percent": n * 10, "status": F.when(n % 3 == 0, "running").when(n % 3 == 1, "completed").otherwise("failed")})


def mon13_thresholds(spark, sf_dir):
    return M.alerts(_per_crawl(spark, sf_dir), (*M.RULES_A, *M.RULES_HOST_A)).select("crawl_id", "rule", "severity")


def mon15_anomalies(spark, sf_dir):
    return M.alerts(_per_crawl(spark, sf_dir), M.RULES_C).select("crawl_id", "rule", "severity")


def mon8_finished(spark, sf_dir):
    return M.finished_rate(_per_crawl(spark, sf_dir)).select(F.round("avg_success_rate", 6).alias("avg_success_rate"))


def mon2_variant(spark, sf_dir):
    m = M.url_counters(_crawl(spark, sf_dir).withColumn("error", F.when(F.col("blocked"), F.lit("Request Blocked")).otherwise(F.col("error"))))
    return m.select("crawl_id", "requests", "urls_crawled", "urls_failed", "blocked", "urls_blocked", "bytes", F.to_json("status_codes").alias("status_codes"))


def crw9_sessions(spark, sf_dir):
    return M.counted(_crawl(spark, sf_dir).withColumn("domain", U.host(F.col("url"))), ["status_code", "domain", "proxy"]).select("kind", "value", "n")


def crw12_by_level(spark, sf_dir):
    line = F.concat(F.lit("2024-01-01 ["), F.upper(F.when(F.col("success"), "info").when(F.col("blocked"), "error").otherwise("warning")), F.lit("] spider: event "), F.col("event_id").cast("string"))
    return M.log_levels(_crawl(spark, sf_dir).select(line.alias("line")), "line")


def pol11_global(spark, sf_dir):
    return P.traffic(_crawl(spark, sf_dir).withColumn("host", U.host(F.col("url")))).select("host", "requests", "blocked", "limited", F.round("avg_response_time", 6).alias("avg_response_time"))


def dst6_fallback(spark, sf_dir):
    """Keys whose three candidates are full go to the least loaded node of all."""
    nodes = base.derived(spark, sf_dir, base.NODES).withColumn("max_tasks", F.lit(4))
    keys = base.derived(spark, sf_dir, base.TASKS).select("task_id")
    three = keys.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")).select("task_id", "rank", F.concat(F.lit("n"), (F.col("task_id") * 5 + F.col("rank") * 7) % 25).alias("node"))
    return C.pick_node(keys, three, "task_id", nodes)


def dst7_workers(spark, sf_dir):
    t = base.derived(spark, sf_dir, base.TASKS).select("task_id")
    w = base.derived(spark, sf_dir, base.NODES).select(F.col("node_id").alias("worker"), "current_tasks")
    return C.assign(t, "task_id", w, "round_robin").withColumn("how", F.lit("round_robin")).unionByName(C.assign(t, "task_id", w, "least_loaded").withColumn("how", F.lit("least_loaded"))).unionByName(C.assign(t, "task_id", w, "random", seed=7).withColumn("how", F.lit("random")))


def sel16_follow(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html", F.concat(F.lit("s"), F.col("page_id") % 3).alias("sid"), (F.col("page_id") % 5).alias("priority"), F.create_map(F.lit("page"), F.col("page_id").cast("string")).alias("meta"), (F.col("page_id") % 4).alias("depth"))
    return C.follow(p, F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).select("url", "referer", "sid", "priority", "depth", F.to_json("meta").alias("meta"))


def sup24_rotate(spark, sf_dir):
    s = base.derived(spark, sf_dir, base.SESSIONS)
    return S.rotated(s, F.col("use_count") > 9, F.lit(1706745600)).select("session_id", "use_count", "rotated_from", "rotated_at", "tag")


def sup25_export(spark, sf_dir):
    """Sessions out as JSON and in again."""
    s = base.derived(spark, sf_dir, base.SESSIONS)
    out = S.sealed(s, ["session_id", "use_count", "tag", "domain"]).select("data")
    return out.select(F.from_json("data", "session_id long, use_count int, tag string, domain string").alias("s")).select("s.*")


def sup26_integrity(spark, sf_dir):
    """Sessions sealed into a store and checked when they are loaded, some of them broken meanwhile."""
    store = stores.SqliteStorage(spark, io.fresh_path(spark), "sessions", ["session_id"], "created_at")
    whole = stores.CheckedStorage(store, "tag string, use_count int, created_at timestamp")
    whole.save(base.derived(spark, sf_dir, base.SESSIONS).select("session_id", "tag", "use_count", F.col("created_at").cast("timestamp").alias("created_at")))
    k = F.col("session_id")
    rows = store.load()
    broken = rows.withColumn("data", F.when(k % 14 == 0, F.concat("data", F.lit(b"x"))).when(k % 15 == 0, F.substring("data", 1, 3)).otherwise(F.col("data"))).withColumn("checksum", F.when(k % 77 == 0, "").otherwise(F.col("checksum")))
    return stores.opened(broken, ["session_id"], whole.schema).select("session_id", "intact", "tag", "use_count", F.unix_micros("created_at").alias("created_us"))


def src9_sqlite(spark, sf_dir):
    """Sessions written to SQLite files by the tasks that have them, and read back by ranges of row numbers."""
    path = io.fresh_path(spark)
    stores.register(spark)
    s = base.derived(spark, sf_dir, base.SESSIONS).select("session_id", "tag", "domain", "use_count", F.col("expires_at").cast("timestamp").alias("expires_at"))
    s.repartition(5).write.format(stores.FORMAT).option("table", "sessions").mode("append").save(path)
    back = spark.read.format(stores.FORMAT).option("table", "sessions").option("splits", "3").load(path)
    return back.select("session_id", "tag", "domain", "use_count", F.unix_micros("expires_at").alias("expires_us"))


def udf10_storage(spark, sf_dir):
    """Elements saved under site and identifier, saved again by a later crawl, and retrieved."""
    store = stores.SqliteStorage(spark, io.fresh_path(spark), "elements", ["site", "identifier"], "crawl")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(U.host(F.col("url")).alias("site"), F.concat(F.lit("page-"), "page_id").alias("identifier"), "page_id", F.length("html").alias("size"))
    store.save(p.select("site", "identifier", F.lit(1).alias("crawl"), "size"))
    store.save(p.filter("page_id % 3 = 0").select("site", "identifier", F.lit(2).alias("crawl"), (F.col("size") + 1).alias("size")))
    return store.retrieve(p.filter("size > 2000")).select("site", "identifier", "crawl", "size")


def sup23_set_cookie(spark, sf_dir):
    k = F.col("page_id").cast("string")
    h = F.concat(F.lit("sid="), k, F.lit("=x; Domain=.example.com"), F.when(F.col("page_id") % 2 == 0, "; Path=/a").otherwise(""), F.when(F.col("page_id") % 3 == 0, "; Expires=Wed, 21 Oct 2026 07:28:00 GMT").otherwise("; expires=soon"), F.when(F.col("page_id") % 5 == 0, "; Max-Age=60").otherwise("; Max-Age=x"), F.when(F.col("page_id") % 4 == 0, "; SameSite=Strict; Secure").otherwise("; HttpOnly"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.set_cookie(h, F.lit(1000.0)).alias("c"))
    return p.select("page_id", "c.*")


def sup30_proxy(spark, sf_dir):
    k = F.col("page_id")
    text = F.concat(F.when(k % 5 == 0, "ftp").when(k % 5 == 1, "socks5").otherwise("http"), F.lit("://"), F.when(k % 3 == 0, F.concat(F.lit("u"), k, F.lit(":p"), k, F.lit("@"))).when(k % 3 == 1, F.concat(F.lit("u"), k, F.lit("@"))).otherwise(""), F.lit("Proxy.example.com"), F.when(k % 2 == 0, ":8080").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.proxy(text).alias("x")).select("page_id", "x.server", "x.username", "x.password")


def sup33_savings(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.savings(F.col("p_retailprice").cast("double")).alias("s"))
    return p.select("p_partkey", *(F.round(f"s.{n}", 6).alias(n) for n in S.SAVINGS))


def rep11_adaptations(spark, sf_dir):
    a = _crawl(spark, sf_dir).select(U.host(F.col("url")).alias("site"), "success", (F.col("bytes") % 100 / 100.0).alias("confidence"))
    return S.success_stats(a, ["site"], "success", "confidence").select("site", "attempts", "successes", F.round("success_rate", 6).alias("success_rate"), F.round("confidence", 6).alias("confidence"))


def sup34_learner(spark, sf_dir):
    a = _crawl(spark, sf_dir).select("crawl_id", "success", (F.col("bytes") % 100 / 100.0).alias("confidence"))
    return S.success_stats(a, [], "success", "confidence").select("attempts", "successes", F.round("success_rate", 6).alias("success_rate"), F.round("confidence", 6).alias("confidence"))


def qs8_consistency_b(spark, sf_dir):
    k = F.col("id")
    r = _records(spark, sf_dir).select("id", F.when(k % 4 == 0, '[1, "a"]').when(k % 4 == 1, "[1, 2]").when(k % 4 == 2, "[]").otherwise('["a", "b"]').alias("tags"), F.lit("[true, false]").alias("flags"), "scraped_date", F.when(k % 3 == 0, "2024-05-06T07:08:09Z").when(k % 3 == 1, "soon").alias("seen_time"))
    return r.select("id", F.round(R.consistency_b(["tags", "flags"], ["scraped_date", "seen_time"]), 6).alias("consistency"))


def qs10_name_groups(spark, sf_dir):
    rows = I.unpivot(_records(spark, sf_dir).withColumnsRenamed({"price": "price1", "rating": "price2", "brand": "sku_code", "review_count": "name_key"}), "id", ["price1", "price2", "sku", "sku_code", "name", "name_key"])
    return R.name_groups(rows)


def inf18_struct(spark, sf_dir):
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "name": {"type": "string"}, "price": {"type": "number"}, "good": {"type": "boolean"}, "tags": {"type": "array", "items": {"type": "integer"}}, "more": {"type": "object"}}, "required": ["id"]}
    r = _records(spark, sf_dir)
    text = F.to_json(F.struct("id", "name", "price", (F.col("id") % 2 == 0).alias("good"), F.array(F.col("id"), F.col("id") + 1).alias("tags"), F.create_map(F.lit("k"), F.col("sku")).alias("more")))
    x = r.select(F.from_json(text, I.struct_type(schema)).alias("x")).select("x.*")
    return x.select("id", "name", "price", "good", F.element_at("tags", 2).alias("second"), F.col("more")["k"].alias("k"))


def inf1_examples(spark, sf_dir):
    rows = I.unpivot(_records(spark, sf_dir), "id", ["currency", "brand", "url", "review_count"])
    return I.examples(rows, 5).select("field", F.array_join("examples", "|").alias("examples"))


def inf2_types(spark, sf_dir):
    rows = I.unpivot(_records(spark, sf_dir), "id", ["name", "price", "review_count", "stamp", "currency"])
    return I.value_types(rows).groupBy("field", "type").agg(F.count("*").alias("n"))


def ext5_steps(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("id", I.applied(F.col("scraped_date"), ["strip", "date_parse"]).alias("day"), I.applied(F.concat(F.lit("  "), "sku", F.lit(",1 ")), ["strip", "lower", "remove_commas"]).alias("sku"))


def enr8_chain(spark, sf_dir):
    """A chain of enrichers in which one fails on some rows and one always."""

    def country(row):
        return {"country": row["url"].split("/")[2].rsplit(".", 1)[-1]}

    def halves(row):
        return {"half": str(10 // (row["id"] % 5))}

    def broken(row):
        raise ValueError("no")

    r = _records(spark, sf_dir).select("id", "url")
    out = X.enriched(r, {"country": country, "halves": halves, "broken": broken})
    return out.select("id", F.col("enriched")["country"].alias("country"), F.col("enriched")["half"].alias("half"), F.array_join("failed", ",").alias("failed"))


def udf6_validators(spark, sf_dir):
    r = _records(spark, sf_dir)
    X.VALIDATORS["shop"] = lambda: [R.Rule("sku", "sku_form", "warning", "odd sku", ~F.col("sku").rlike("^SKU-[0-9]*[02468]$")), R.Rule("price", "cheap", "error", "too cheap", F.col("price") < 100)]
    return X.validated(r, ["shop"]).select("id", F.array_join(F.transform("issues", lambda x: x["code"]), ",").alias("codes"), "is_valid")


def snk3_forms(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = [io.content(p, e).select("url", F.lit(e).alias("form"), F.md5("content").alias("md5")) for e in (".html", ".txt", ".md")]
    return made[0].unionByName(made[1]).unionByName(made[2])


def snk5_expiry(spark, sf_dir):
    """Rows whose key was not sunk within 30 days before."""
    e = _crawl(spark, sf_dir).selectExpr("url AS sink_key", "CAST(event_id % 400 AS BIGINT) AS day", "event_id")
    return T.sink_unseen(e, "sink_key", "day", "event_id", 30).select("sink_key", "day", "event_id")


def snk9_knowledge(spark, sf_dir):
    """Knowledge out as JSON lines and in again."""
    k = _records(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("n"), F.collect_set("currency").alias("currencies"))
    path = io.fresh_path(spark)
    io.save_knowledge(k, path)
    return io.load_knowledge(spark, path, "brand string, n long, currencies array<string>").select("brand", "n", F.array_join(F.sort_array("currencies"), ",").alias("currencies"))


def crw5_snapshot(spark, sf_dir):
    """A queue out and in again, in its order."""
    t = base.derived(spark, sf_dir, base.TASKS).filter("status = 'pending'").select("task_id", "priority", "created_at")
    path = io.fresh_path(spark)
    io.snapshot(t, path)
    return C.dequeue(io.restore(spark, path), "priority", "task_id", 25).select("task_id", "priority")


def sup19_worker(spark, sf_dir):
    c = _crawl(spark, sf_dir)
    found = c.select("url", "depth", F.array(F.concat(F.lit("http://h"), F.col("bytes") % 40, F.lit(".example.com/p/"), F.col("bytes") % 60)).alias("links"))
    return C.work_step(found, c.select("url").distinct(), 3)


def scl5_forecast(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    per = e.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return T.schedule(per, "hour", "n", 5).select("hour", "most", F.round("mean", 6).alias("mean"), "replicas")


def sup12_metadata(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", U.url_pattern(F.col("url")).alias("pattern"), "url", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("title"))
    rows = I.unpivot(p, "page_id", ["url", "title"]).join(p.select("page_id", "pattern"), "page_id")
    return I.schema_by(rows, "pattern", "page_id").select("pattern", "field", "samples", "type", "required", F.round("confidence", 6).alias("confidence"))


_PERMIT = "(SELECT *, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM {t})"
_CNT = f"(SELECT crawl_id, CAST(regexp_extract(crawl_id, '(\\d+)', 1) AS INT) AS k, count(*) AS requests, 100.0 * count(*) FILTER (success) / count(*) AS success_rate, 100.0 * count(*) FILTER (blocked) / count(*) AS block_rate, avg(response_time) AS avg_response_time FROM {_E} GROUP BY crawl_id)"
_KEPT = f"SELECT id, list_filter([CASE WHEN NOT regexp_matches(sku, '^SKU-[0-9]*[02468]$') THEN 'sku_form' END, CASE WHEN price < 100 THEN 'cheap' END], lambda x: x IS NOT NULL) AS codes, price FROM {_R}"


def _alerts(rules: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {{key}}, '{n}' AS rule, '{s}' AS severity FROM {{t}} WHERE {c}" for n, (c, s) in rules.items())


SQL: dict[str, str | None] = {
    "sup20_transitions": f"SELECT t.task_id, CASE WHEN o.task_id IS NULL THEN t.status WHEN o.x.ok THEN 'completed' ELSE 'failed' END AS status, CASE WHEN NOT o.x.ok THEN o.x.error END AS error, o.x.at AS completed_at FROM {_T} t LEFT JOIN (SELECT task_id, arg_max({{'ok': ok, 'error': error, 'at': at}}, at) AS x FROM {_O.replace(' AS at', ' AS \"at\"')} GROUP BY task_id) o USING (task_id)".replace("'at': at", "'at': \"at\"").replace(", at)", ", \"at\")").replace("o.x.at", "o.x['at']"),
    "sup20_nodes": f"SELECT n.node_id, coalesce(c, 0) AS completed, coalesce(f, 0) AS failed, greatest(0, n.current_tasks - coalesce(c, 0) - coalesce(f, 0)) AS current_tasks FROM {_N} n LEFT JOIN (SELECT 'n' || (event_id % 20) AS node_id, count(*) FILTER (event_type <> 'error') AS c, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1) USING (node_id)",
    "pol3_by_host": "SELECT url, " + _ALLOWED + " AS allowed FROM " + _PERMIT.format(t=f"(SELECT DISTINCT url FROM {_E})"),
    "sup27_gate": "SELECT event_id, ok AND active < 8 AND tokens >= 1 AS allowed, round(CASE WHEN NOT ok THEN 0 WHEN active >= 8 THEN 1 WHEN tokens >= 1 THEN 0 ELSE (1 - tokens) / 0.5 END::DOUBLE, 6) AS wait_time, CASE WHEN NOT ok THEN 'disallowed by robots.txt' WHEN active >= 8 THEN 'too many concurrent requests' END AS error FROM (SELECT event_id, bytes % 7 / 4.0 AS tokens, bytes % 11 AS active, " + _ALLOWED + " AS ok FROM " + _PERMIT.format(t=_E) + ")",
    "sup28_wait": f"SELECT event_id, decision, CASE WHEN decision = 'granted' THEN round(b + t + d, 6) END AS waited FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'disallowed' WHEN b > 30 THEN 'backoff' WHEN t > 30 THEN 'throttled' WHEN d > 30 THEN 'rate_limited' ELSE 'granted' END AS decision FROM (SELECT event_id, (bytes % 60)::DOUBLE AS b, CASE WHEN bytes % 3 = 0 THEN greatest(0, bytes % 50 - 10) ELSE 0 END::DOUBLE AS t, (bytes % 37)::DOUBLE AS d FROM {_E}))",
    "sup22_system_alerts": _alerts({"high_memory": ("bytes * 7 % 101 > 90", "critical"), "high_cpu": ("bytes % 101 > 80", "warning")}).format(key="event_id", t=_E),
    "mon13_thresholds": _alerts({"low_success": ("success_rate < 80", "warning"), "high_block": ("block_rate > 30", "critical"), "slow": ("requests > 10 AND avg_response_time > 10", "warning"), "high_cpu": ("k * 11 > 80", "warning"), "high_memory": ("k * 10 > 85", "warning")}).format(key="crawl_id", t=_CNT),
    "mon15_anomalies": _alerts({"high_cpu": ("k * 11 > 90", "warning"), "high_memory": ("k * 10 > 85", "warning"), "blocks": ("k % 3 = 0 AND block_rate > 30 AND requests > 10", "critical"), "slow": ("k % 3 = 0 AND avg_response_time > 10 AND requests > 5", "warning")}).format(key="crawl_id", t=_CNT),
    "mon8_finished": f"SELECT round(coalesce(avg(success_rate), 0), 6) AS avg_success_rate FROM {_CNT} WHERE k % 3 <> 0",
    "mon2_variant": f"SELECT c.crawl_id, requests, urls_crawled, urls_failed, blocked, urls_blocked, bytes, '{{' || string_agg('\"' || s.status_code || '\":' || s.n, ',' ORDER BY s.status_code) || '}}' AS status_codes FROM (SELECT crawl_id, count(*) AS requests, count(DISTINCT url) AS urls_crawled, count(DISTINCT url) FILTER (NOT success) AS urls_failed, count(*) FILTER (NOT success AND (blocked OR status_code IN (403, 429))) AS blocked, count(DISTINCT url) FILTER (NOT success AND (blocked OR status_code IN (403, 429))) AS urls_blocked, CAST(coalesce(sum(bytes) FILTER (success), 0) AS BIGINT) AS bytes FROM {_E} GROUP BY crawl_id) c JOIN (SELECT crawl_id, status_code, count(*) AS n FROM {_E} WHERE success GROUP BY ALL) s USING (crawl_id) GROUP BY ALL",
    "crw9_sessions": f"SELECT 'status_code' AS kind, CAST(status_code AS VARCHAR) AS value, count(*) AS n FROM {_E} GROUP BY ALL UNION ALL SELECT 'domain', regexp_extract(url, '://([^/]*)', 1), count(*) FROM {_E} GROUP BY ALL UNION ALL SELECT 'proxy', proxy, count(*) FROM {_E} GROUP BY ALL",
    "crw12_by_level": f"SELECT CASE WHEN success THEN 'INFO' WHEN blocked THEN 'ERROR' ELSE 'WARNING' END AS level, count(*) AS n FROM {_E} GROUP BY 1",
    "pol11_global": f"SELECT host, count(*) AS requests, count(*) FILTER (blocked) AS blocked, count(*) FILTER (status_code IN (429, 503)) AS limited, round(avg(response_time), 6) AS avg_response_time FROM (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS host FROM {_E}) GROUP BY ROLLUP (host)",
    "dst6_fallback": f"WITH n AS (SELECT node_id AS node, CASE WHEN current_tasks < 4 THEN current_tasks / 4 END AS load FROM {_N}), c AS (SELECT task_id, r AS rank, 'n' || ((task_id * 5 + r * 7) % 25) AS node FROM {_T}, range(3) x(r)), p AS (SELECT task_id, arg_min(node, (load, rank, node)) FILTER (load IS NOT NULL) AS node FROM c JOIN n USING (node) GROUP BY task_id) SELECT task_id, coalesce(node, (SELECT arg_min(node, (load, node)) FROM n WHERE load IS NOT NULL)) AS node FROM p",
    "dst7_workers": f"WITH w AS (SELECT node_id AS worker, current_tasks, row_number() OVER (ORDER BY node_id) - 1 AS i, count(*) OVER () AS n FROM {_N}), t AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS k, ('0x' || substr(md5(task_id || ':7'), 1, 8))::BIGINT AS h FROM {_T}) SELECT task_id, worker, 'round_robin' AS how FROM t JOIN w ON t.k % w.n = w.i UNION ALL SELECT task_id, (SELECT arg_min(worker, (current_tasks, worker)) FROM w), 'least_loaded' FROM t UNION ALL SELECT task_id, worker, 'random' FROM t JOIN w ON t.h % w.n = w.i",
    "sel16_follow": "SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h AS url, url AS referer, 's' || (page_id % 3) AS sid, page_id % 5 AS priority, page_id % 4 + 1 AS depth, '{\"page\":\"' || page_id || '\"}' AS meta FROM (SELECT *, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages)",
    "sup24_rotate": f"SELECT CASE WHEN use_count > 9 THEN md5(session_id || '|1706745600') ELSE CAST(session_id AS VARCHAR) END AS session_id, CASE WHEN use_count > 9 THEN 0 ELSE use_count END AS use_count, CASE WHEN use_count > 9 THEN CAST(session_id AS VARCHAR) END AS rotated_from, CASE WHEN use_count > 9 THEN 1706745600 END AS rotated_at, tag FROM {_S}",
    "sup25_export": f"SELECT session_id, use_count, tag, domain FROM {_S}",
    "sup26_integrity": f"SELECT session_id, ok AS intact, CASE WHEN ok THEN tag END AS tag, CASE WHEN ok THEN use_count END AS use_count, CASE WHEN ok THEN epoch_us(created_at) END AS created_us FROM (SELECT *, session_id % 14 <> 0 AND session_id % 15 <> 0 AND session_id % 77 <> 0 AS ok FROM {_S})",
    "src9_sqlite": f"SELECT session_id, tag, domain, use_count, epoch_us(expires_at) AS expires_us FROM {_S}",
    "udf10_storage": "SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS site, 'page-' || page_id AS identifier, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS crawl, CAST(length(html) + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS size FROM pages WHERE length(html) > 2000",
    "sup23_set_cookie": "SELECT page_id, 'sid' AS name, page_id || '=x' AS value, '.example.com' AS domain, CASE WHEN page_id % 2 = 0 THEN '/a' ELSE '/' END AS path, CASE WHEN page_id % 5 = 0 THEN 1060 WHEN page_id % 3 = 0 THEN epoch(TIMESTAMP '2026-10-21 07:28:00') END::DOUBLE AS expires, CASE WHEN page_id % 4 = 0 THEN 'Strict' ELSE 'Lax' END AS same_site, page_id % 4 = 0 AS secure, page_id % 4 <> 0 AS http_only FROM pages",
    "sup30_proxy": "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 5 = 1 THEN 'socks5' ELSE 'http' END || '://proxy.example.com' || CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END END AS server, CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 3 < 2 THEN 'u' || page_id ELSE '' END END AS username, CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE '' END END AS password FROM pages",
    "sup33_savings": "SELECT p_partkey, " + ", ".join(f"round(CAST(p_retailprice AS DOUBLE) * {v}, 6) AS {k}" for k, v in S.SAVINGS.items()) + " FROM part",
    "rep11_adaptations": f"SELECT regexp_extract(url, '://([^/]*)', 1) AS site, count(*) AS attempts, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(coalesce(avg(bytes % 100 / 100.0) FILTER (success), 0), 6) AS confidence FROM {_E} GROUP BY 1",
    "sup34_learner": f"SELECT count(*) AS attempts, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(coalesce(avg(bytes % 100 / 100.0) FILTER (success), 0), 6) AS confidence FROM {_E}",
    "qs8_consistency_b": f"SELECT id, round((1 - CASE WHEN id % 4 = 0 THEN 0.1 ELSE 0 END - CASE WHEN scraped_date LIKE '%/%' THEN 0.1 ELSE 0 END - CASE WHEN id % 3 = 1 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS consistency FROM {_R}",
    "qs10_name_groups": "SELECT * FROM (VALUES ('price', CAST(2 AS BIGINT), true), ('sku', 2, true), ('name', 2, false)) t(base, fields, one_type)",
    "inf18_struct": f"SELECT CAST(id AS BIGINT) AS id, name, CAST(price AS DOUBLE) AS price, id % 2 = 0 AS good, CAST(id + 1 AS BIGINT) AS second, sku AS k FROM {_R}",
    "inf1_examples": f"SELECT field, array_to_string(list(value ORDER BY value)[1:5], '|') AS examples FROM (SELECT DISTINCT field, value FROM (SELECT unnest(['currency', 'brand', 'url', 'review_count']) AS field, unnest([currency, brand, url, CAST(review_count AS VARCHAR)]) AS value FROM {_R}) WHERE value IS NOT NULL) GROUP BY field",
    "inf2_types": f"SELECT field, CASE WHEN v IS NULL THEN 'null' WHEN field = 'price' THEN 'number' WHEN field = 'review_count' THEN 'integer' ELSE 'string' END AS type, count(*) AS n FROM (SELECT unnest(['name', 'price', 'review_count', 'stamp', 'currency']) AS field, unnest([name, CAST(price AS VARCHAR), CAST(review_count AS VARCHAR), CAST(stamp AS VARCHAR), currency]) AS v FROM {_R}) GROUP BY ALL",
    "ext5_steps": f"SELECT id, CASE WHEN scraped_date LIKE '%/%' THEN '2024-02-01' ELSE scraped_date END AS day, lower(sku) || '1' AS sku FROM {_R}",
    "enr8_chain": f"SELECT id, CASE WHEN url IS NOT NULL THEN list_extract(string_split(string_split(url, '/')[3], '.'), -1) END AS country, CASE WHEN id % 5 <> 0 THEN CAST(10 // (id % 5) AS VARCHAR) END AS half, array_to_string(list_filter([CASE WHEN url IS NULL THEN 'country' END, CASE WHEN id % 5 = 0 THEN 'halves' END, 'broken'], lambda x: x IS NOT NULL), ',') AS failed FROM {_R}",
    "udf6_validators": f"SELECT id, array_to_string(codes, ',') AS codes, NOT coalesce(price < 100, false) AS is_valid FROM ({_KEPT})",
    "snk3_forms": f"SELECT url, '.html' AS form, md5(html) AS md5 FROM pages UNION ALL SELECT url, '.txt', text_md5 FROM pages JOIN ({HTML['conv1_text']}) USING (page_id) UNION ALL SELECT url, '.md', markdown_md5 FROM pages JOIN ({TREE['conv2_markdown']}) USING (page_id)",
    "snk5_expiry": f"WITH RECURSIVE e AS (SELECT url AS sink_key, CAST(event_id % 400 AS BIGINT) AS day, min(event_id) AS event_id FROM {_E} GROUP BY ALL), s AS (SELECT sink_key, min(day) AS day FROM e GROUP BY sink_key UNION ALL SELECT s.sink_key, (SELECT min(e.day) FROM e WHERE e.sink_key = s.sink_key AND e.day >= s.day + 30) FROM s WHERE s.day IS NOT NULL) SELECT s.sink_key, s.day, e.event_id FROM s JOIN e USING (sink_key, day)",
    "snk9_knowledge": f"SELECT brand, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT currency) FILTER (currency IS NOT NULL)), ','), '') AS currencies FROM {_R} GROUP BY brand",
    "crw5_snapshot": f"SELECT task_id, priority FROM {_T} WHERE status = 'pending' ORDER BY priority, task_id LIMIT 25",
    "sup19_worker": f"SELECT url, min(d) AS depth FROM (SELECT 'http://h' || (bytes % 40) || '.example.com/p/' || (bytes % 60) AS url, depth + 1 AS d FROM {_E} WHERE depth < 3) WHERE url NOT IN (SELECT url FROM {_E}) GROUP BY url",
    "scl5_forecast": "SELECT hour, max(n) AS most, round(avg(n), 6) AS mean, CAST(ceil(max(n) / 5) AS BIGINT) AS replicas FROM (SELECT user_id, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL) GROUP BY hour",
    "sup12_metadata": "WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1) = '' THEN '' ELSE '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1) END AS pattern, unnest(['url', 'title']) AS field, unnest([url, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)]) AS v FROM pages), s AS (SELECT pattern, field, count(*) AS samples, 'string' AS type, count(v) FILTER (v <> '') = count(*) AS required, count(v) FILTER (v <> '') / count(*) AS share FROM p GROUP BY pattern, field) SELECT pattern, field, samples, type, required, round(least(1.0, samples / 10) * avg(share) OVER (PARTITION BY pattern), 6) AS confidence FROM s",
}
QUERIES = {name: globals()[name] for name in SQL}
