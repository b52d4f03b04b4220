"""Queries of sources and sinks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import tables as X
from docloom.plans import base
from docloom.functions.status import REASONS, reason
from docloom.sources import io


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def src3_responses(spark, sf_dir):
    ct = F.when(F.col("page_id") % 3 == 0, 'text/html; charset="ISO-8859-1"').when(F.col("page_id") % 3 == 1, "text/html; charset=UTF-8").otherwise("text/html")
    r = io.responses(_pages(spark, sf_dir), ct, F.when(F.col("page_id") % 10 == 0, 404).otherwise(200))
    return r.select("url", F.col("status").cast("long").alias("status"), "reason", F.col("headers")["content-type"].alias("content_type"), "encoding", F.length("body").cast("long").alias("n"))


def sup31_reasons(spark, sf_dir):
    """Texts of all sorts of status codes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 97 == 0, None).otherwise(90 + F.col("event_id") % 440).alias("status"))
    return e.select("event_id", reason(F.col("status")).alias("reason"))


def src6_curl(spark, sf_dir):
    cmd = F.concat(F.lit("curl -X PUT '"), F.col("url"), F.lit("' -H 'Accept: text/html' -H 'Cookie: a=1; b=2' --data-raw 'k="), F.col("page_id"), F.lit("'"))
    r = io.curl_requests(_pages(spark, sf_dir).select("page_id", cmd.alias("cmd")), "cmd")
    return r.select("page_id", F.col("request.method").alias("method"), F.col("request.url").alias("url"), F.col("request.headers")["Accept"].alias("accept"), F.col("request.cookies")["b"].alias("b"), F.col("request.body").alias("body"))


def src7_headers(spark, sf_dir):
    h = F.concat(F.lit("Host: "), F.col("page_id"), F.lit("\r\nX-A: 1\nbad line\nx-a: 2"))
    c = F.concat(F.lit("k="), F.col("page_id"), F.lit("; t=a=b; k=last"))
    return _pages(spark, sf_dir).select("page_id", io.header_map(h)["host"].alias("host"), io.header_map(h)["x-a"].alias("xa"), io.cookie_map(c)["k"].alias("k"), io.cookie_map(c)["t"].alias("t"))


def src8_har(spark, sf_dir):
    a = X.assemble(base.derived(spark, sf_dir, base.SESSIONS), base.derived(spark, sf_dir, base.COOKIES))
    return io.har_cookies(io.har_export(a, "session_id", "cookies"), "har", "session_id")


def snk2_json_lines(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return io.json_lines(n.select("n_nationkey", "n_name"))


def snk1_json_arrays(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_nationkey")
    return io.json_arrays(n, "n_regionkey", "n_nationkey")


SQL: dict[str, str | None] = {
    "src3_responses": "SELECT url, CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END::BIGINT AS status, CASE WHEN page_id % 10 = 0 THEN 'Not Found' ELSE 'OK' END AS reason, CASE page_id % 3 WHEN 0 THEN 'text/html; charset=\"ISO-8859-1\"' WHEN 1 THEN 'text/html; charset=UTF-8' ELSE 'text/html' END AS content_type, CASE page_id % 3 WHEN 0 THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding, length(html) AS n FROM pages",
    "sup31_reasons": "SELECT event_id, coalesce(reason, 'Unknown Status Code') AS reason FROM (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN 90 + event_id % 440 END AS status FROM events) LEFT JOIN (VALUES " + ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in REASONS.items()) + ") r(status, reason) USING (status)",
    "src6_curl": "SELECT page_id, 'PUT' AS method, url, 'text/html' AS accept, '2' AS b, 'k=' || page_id AS body FROM pages",
    "src7_headers": "SELECT page_id, CAST(page_id AS VARCHAR) AS host, '2' AS xa, 'last' AS k, 'a=b' AS t FROM pages",
    "src8_har": f"SELECT session_id, name, arg_max(value, ord) AS value, domain FROM ({base.COOKIES}) WHERE session_id IN (SELECT c_custkey FROM customer) GROUP BY session_id, name, domain",
    "snk2_json_lines": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation",
    "snk1_json_arrays": "SELECT n_regionkey, '[' || string_agg('{\"n_regionkey\":' || n_regionkey || ',\"n_nationkey\":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']' AS array FROM nation GROUP BY n_regionkey",
}
QUERIES = {name: globals()[name] for name in SQL}
