"""Derived input tables, in SQL that Spark and DuckDB read alike.

The operators work on records, crawl results, tasks and sessions.  These are
made of the star-schema tables by expressions that put in every edge case: nulls,
empty strings, bad formats, ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

RECORDS = """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 17 = 0 THEN 'ftp://x/' || p_partkey WHEN p_partkey % 11 = 0 THEN NULL
    ELSE 'https://shop' || (p_partkey % 5) || '.example.' || CASE p_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'com' ELSE 'fr' END || '/item/' || p_partkey END AS url,
  CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 13 = 0 THEN -p_retailprice WHEN p_partkey % 19 = 0 THEN NULL ELSE p_retailprice END AS price,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'usd' ELSE 'USD' END AS currency,
  CASE p_partkey % 5 WHEN 0 THEN 'A great and excellent ' || p_name WHEN 1 THEN 'Bad, broken ' || p_name WHEN 2 THEN 'lorem ipsum <b>' || p_name || '</b>'
    WHEN 3 THEN NULL ELSE 'good but terrible and awful ' || p_name END AS description,
  p_brand AS brand, 'SKU-' || p_partkey AS sku,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(7.5 AS DOUBLE) ELSE CAST(p_partkey % 50 AS DOUBLE) / 10 END AS rating,
  CAST(p_size - 3 AS BIGINT) AS review_count,
  CASE WHEN p_partkey % 9 = 0 THEN 'nobody' ELSE 'a' || p_partkey || '@x.org' END AS contact_email,
  CASE WHEN p_partkey % 8 = 0 THEN '01/02/2024' ELSE '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') END AS scraped_date,
  CASE WHEN p_partkey % 21 = 0 THEN NULL ELSE CAST('202' || (2 + p_partkey % 3) || '-01-' || lpad(CAST(p_partkey % 31 + 1 AS STRING), 2, '0') || ' 06:00:00' AS TIMESTAMP) END AS stamp
FROM part
"""

CRAWL = """
SELECT event_id, ts, 'c' || (user_id % 10) AS crawl_id, 'http://h' || (user_id % 30) || '.example.com/p/' || (event_id % 50) AS url,
  event_type <> 'error' AS success, event_type = 'error' AND event_id % 3 = 0 AS blocked,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 403 WHEN event_id % 3 = 1 THEN 503 ELSE 404 END AS status_code,
  sqrt(value) / 3 AS response_time, CASE WHEN event_type = 'error' THEN 'Error' || (event_id % 4) END AS error,
  'p' || (user_id % 5) AS proxy, CAST(user_id % 4 AS INT) AS depth, CAST(event_id % 1000 AS BIGINT) AS bytes
FROM events
"""

TASKS = """
SELECT o_orderkey AS task_id, 'http://h' || (o_custkey % 40) || '.example.com/' || (o_orderkey % 300) || CASE WHEN o_orderkey % 3 = 0 THEN '?b=2&a=' || (o_orderkey % 2) WHEN o_orderkey % 3 = 1 THEN '#top' ELSE '' END AS url,
  'h' || (o_custkey % 40) AS domain, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS priority, CAST(o_orderkey % 6 AS INT) AS depth, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, CAST(o_orderkey % 5 AS INT) AS retry_count, o_orderkey % 10 = 0 AS dont_filter
FROM orders
"""

NODES = """
SELECT 'n' || n_nationkey AS node_id, CAST(n_nationkey % 7 AS INT) AS current_tasks, CAST(10 AS INT) AS max_tasks, CAST('2024-01-31 23:5' || (n_nationkey % 10) || ':30' AS TIMESTAMP) AS last_heartbeat
FROM nation
"""

SESSIONS = """
SELECT c_custkey AS session_id, CAST('2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || ' 0' || (c_custkey % 10) || ':00:00' AS TIMESTAMP) AS created_at,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST('2024-02-' || lpad(CAST(c_custkey % 3 + 1 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP) END AS expires_at,
  CAST(c_custkey % 13 AS INT) AS use_count, c_mktsegment AS tag, 'd' || c_nationkey || '.example.com' AS domain
FROM customer
"""

COOKIES = """
SELECT o_custkey AS session_id, 'k' || (o_orderkey % 5) AS name, o_orderpriority AS value, CASE WHEN o_orderkey % 2 = 0 THEN '.example.com' ELSE 'd' || (o_custkey % 25) || '.example.com' END AS domain, o_orderkey AS ord
FROM orders
"""



def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above over the Parquet table that it names."""
    head, _, rest = sql.strip().rpartition("FROM ")
    df = spark.read.parquet(f"{sf_dir}/{rest.strip()}.parquet")
    return df.selectExpr(*_expressions(head.removeprefix("SELECT")))


def _expressions(text: str) -> list[str]:
    """Split a select list at its outer commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not quoted and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]
