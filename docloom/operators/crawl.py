"""Crawl dataflow: frontier order, filters, routing on a hash ring, retries.

Routing is a forward as-of join: the ring (nodes x replicas, a size that the
caller knows) is cut into intervals of the hash, and keys are joined to intervals
by the leading digits of their hash, so that no task compares all keys with all
ring points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators.state import checkpointed, written

REPLICAS = 100
#: Statuses of a blocked response.
BLOCKED = (401, 403, 407, 429, 444, 500, 502, 503, 504)
#: Leading hex digits by which ring and keys are joined.
DIGITS = 2


def fingerprint(url: Column, method: Column, body: Column, sid: Column) -> Column:
    """SHA-1 of the request as JSON with its keys in order."""
    return F.sha1(F.to_json(F.struct(body.alias("body"), method.alias("method"), sid.alias("sid"), U.canonical(url).alias("url"))))


def priority_score(priority: Column, depth: Column, created: Column, as_of: Column) -> Column:
    """Lower is sooner: priority, then depth, and older first."""
    return priority * 1000 + depth * 100 - (as_of.cast("timestamp").cast("double") - created.cast("timestamp").cast("double")) / 3600


def dequeue(tasks: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    return tasks.orderBy(score, tie).limit(limit)


def slots(tasks: DataFrame, domain: str, score: str, tie: str, delay: float) -> DataFrame:
    """Start second of each task, one task of a domain per ``delay``."""
    w = Window.partitionBy(domain).orderBy(score, tie)
    return tasks.withColumn("slot", (F.row_number().over(w) - 1) * delay)


def split_offsite(requests: DataFrame, url: str, domains: DataFrame, domain: str) -> DataFrame:
    """Add ``allowed``: the host or one of its parents is in ``domains``.

    Every suffix of a host is a key, so the theta join is an equi-join.
    """
    h = F.split(U.host(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_join(F.slice(h, i, F.size(h)), "."))
    numbered = requests.withColumn("_row", F.monotonically_increasing_id())
    hits = numbered.select("_row", F.explode(suffixes).alias("_d")).join(domains.select(F.col(domain).alias("_d")).distinct(), "_d", "left_semi").select("_row").distinct()
    return numbered.join(hits.withColumn("allowed", F.lit(True)), "_row", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False))).drop("_row")


def retries(results: DataFrame, most: int, *, is_blocked: Column | None = None, again: dict[str, Column] | None = None) -> DataFrame:
    """Blocked results to try again, one priority lower.

    ``is_blocked`` is a condition in place of the status list, ``again`` are columns
    that a request to try again gets besides (a proxy, say); null conditions are false.
    """
    blocked = F.col("status_code").isin(*BLOCKED) if is_blocked is None else is_blocked
    left = results.filter(F.coalesce(blocked, F.lit(False)) & (F.col("retry_count") < most))
    return left.withColumns({"priority": F.col("priority") - 1, "retry_count": F.col("retry_count") + 1, **(again or {})})


def backoff(attempts: Column, base: float = 2.0, most: float = 300.0) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(base), attempts))


def ring(nodes: DataFrame, node: str, replicas: int = REPLICAS) -> DataFrame:
    """(h, node): points in hash order; hex strings of one width order like numbers."""
    points = nodes.select(F.col(node).alias("node")).distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("i"))
    return points.select(F.md5(F.concat("node", F.lit(":"), "i")).alias("h"), "node")


def route(keys: DataFrame, key: str, points: DataFrame) -> DataFrame:
    """Add ``node``: the owner of the first ring point at or after the key's hash, the first of all past the end.

    The ring's points are nodes x replicas, so they and one more for each prefix
    without points can be broadcast; each key meets the points of its prefix only.
    """
    span = 16**DIGITS
    prefix = lambda h: F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int")
    own = points.groupBy(prefix(F.col("h")).alias("p")).agg(F.sort_array(F.collect_list(F.struct("h", "node"))).alias("points"))
    all_prefixes = points.sparkSession.range(span).select(F.col("id").cast("int").alias("p")).join(own, "p", "left")
    after = Window.orderBy(F.desc("p"))  # a row for each prefix, 16 ** DIGITS of them
    wrap = points.agg(F.min(F.struct("h", "node")).alias("wrap"))
    head = all_prefixes.withColumn("next", F.last(F.get("points", F.lit(0)), ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1)))
    table = head.crossJoin(F.broadcast(wrap)).select("p", F.coalesce("points", F.array().cast("array<struct<h:string,node:string>>")).alias("points"), F.coalesce("next", "wrap").alias("next"))
    hashed = keys.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("p", prefix(F.col("_h")))
    found = hashed.join(F.broadcast(table), "p")
    at = F.get(F.filter("points", lambda x: x["h"] >= F.col("_h")), F.lit(0))
    return found.withColumn("node", F.coalesce(at["node"], F.col("next.node"))).drop("_h", "p", "points", "next")


def successors(keys: DataFrame, key: str, points: DataFrame, count: int = 3) -> DataFrame:
    """(key, rank, node): the first ``count`` distinct nodes from the key on around the ring.

    The ring as one broadcast array of (h, node), nodes x replicas long.
    """
    whole = points.agg(F.sort_array(F.collect_list(F.struct("h", "node"))).alias("points"))
    hashed = keys.select(key, F.md5(F.col(key).cast("string")).alias("_h")).crossJoin(F.broadcast(whole))
    turned = F.concat(F.filter("points", lambda x: x["h"] >= F.col("_h")), F.filter("points", lambda x: x["h"] < F.col("_h")))
    nodes = F.slice(F.array_distinct(F.transform(turned, lambda x: x["node"])), 1, count)
    return hashed.select(key, F.posexplode(nodes).alias("rank", "node"))


def least_loaded(candidates: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """(key, node): of each key's candidates the available node with the least load, ties by rank."""
    load = F.when(F.col("current_tasks") < F.col("max_tasks"), F.col("current_tasks") / F.col("max_tasks"))
    j = candidates.join(F.broadcast(nodes.select(F.col("node_id").alias("node"), load.alias("load"))), "node").filter("load IS NOT NULL")
    return j.groupBy(key).agg(F.min(F.struct("load", "rank", "node")).alias("x")).select(key, "x.node")


def alive(nodes: DataFrame, as_of: Column, seconds: int = 90) -> DataFrame:
    age = as_of.cast("timestamp").cast("double") - F.col("last_heartbeat").cast("timestamp").cast("double")
    return nodes.withColumn("alive", age <= seconds)


def levels(pages: DataFrame, page_url: str, links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): breadth-first over links (src, dst) from the seeds, a level a round, first depth kept.

    Each round joins the frontier to the links and drops what was seen; the
    table of seen URLs is checkpointed, so its lineage stays short.
    """
    known = pages.select(F.col(page_url).alias("url")).distinct()
    seen = checkpointed(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        front = seen.filter(F.col("depth") == d - 1).join(known, "url", "left_semi")
        new = checkpointed(front.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if not new.limit(1).count():
            break
        seen = checkpointed(seen.unionByName(new))
    return seen


def pick_node(keys: DataFrame, candidates: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """(key, node): the least loaded candidate that has room; where all are full, the least loaded node of all that has."""
    load = F.when(F.col("current_tasks") < F.col("max_tasks"), F.col("current_tasks") / F.col("max_tasks"))
    rest = nodes.select(load.alias("load"), "node_id").filter("load IS NOT NULL").agg(F.min(F.struct("load", "node_id")).alias("x")).select(F.col("x.node_id").alias("rest"))
    best = keys.select(key).distinct().join(least_loaded(candidates, key, nodes), key, "left")
    return best.crossJoin(F.broadcast(rest)).select(key, F.coalesce("node", "rest").alias("node"))


def assign(tasks: DataFrame, key: str, workers: DataFrame, how: str, seed: int = 0) -> DataFrame:
    """(key, worker): in turn by the order of keys, to the least loaded, or by a hash of the key and a seed.

    Workers are a cluster's nodes, numbered in one broadcast row.  Turns need the
    rank of every key: keys are range-partitioned, and each range counts on from
    the sizes of the ranges before it.
    """
    all_ = workers.agg(F.array_sort(F.collect_list("worker")).alias("ws"), F.min(F.struct("current_tasks", "worker")).alias("least"))
    if how == "round_robin":
        ranged = written(tasks.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()))
        sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
        numbered = within.join(F.broadcast(sizes.select("part", "before")), "part").select(key, (F.col("before") + F.col("i")).alias("k"))
    else:
        numbered = tasks.select(key, F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long").alias("k"))
    j = numbered.crossJoin(F.broadcast(all_))
    return j.select(key, (F.col("least.worker") if how == "least_loaded" else F.get("ws", (F.col("k") % F.size("ws")).cast("int"))).alias("worker"))


def follow(pages: DataFrame, links: Column) -> DataFrame:
    """Requests for a page's links: absolute, a level deeper, with its session, priority and meta, and itself as referer."""
    found = pages.withColumn("href", F.explode(links))
    return found.select(U.resolve(F.col("url"), F.col("href")).alias("url"), F.col("url").alias("referer"), "sid", "priority", (F.col("depth") + 1).alias("depth"), "meta")


def work_step(results: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """(url, depth): what a worker adds after its pages (url, depth, links): unseen links of pages above the greatest depth, at their least depth."""
    links = results.filter(F.col("depth") < most).select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth"))
    return links.groupBy("url").agg(F.min("depth").alias("depth")).join(seen, "url", "left_anti")


def pending(tasks: DataFrame, limit: int, status: str = "pending") -> DataFrame:
    """The first ``limit`` tasks of a status by priority, age and id."""
    return tasks.filter(F.col("status") == status).orderBy("priority", "created_at", "task_id").limit(limit)
