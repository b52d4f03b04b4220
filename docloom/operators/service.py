"""What a crawl's services decide, as columns: request gates, task transitions, sessions, cookies, proxies, costs, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the cost that each measure saves.
SAVINGS = {"auto_scaling": 0.3, "spot_instances": 0.7, "right_sizing": 0.2, "reserved_instances": 0.4}
#: Schemes that a proxy can have.
PROXY_SCHEMES = ("http", "https", "socks4", "socks5")


# tasks


def transitions(tasks: DataFrame, outcomes: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks with the state that the last outcome (key, ok, error, at) leaves them in; tasks without one stay as they are."""
    last = outcomes.groupBy(key).agg(F.max_by(F.struct("ok", "error", "at"), "at").alias("o"))
    j = tasks.join(last, key, "left")
    status = F.when(F.col("o").isNull(), F.col("status")).when(F.col("o.ok"), "completed").otherwise("failed")
    return j.withColumns({"status": status, "error": F.when(~F.col("o.ok"), F.col("o.error")), "completed_at": F.col("o.at")}).drop("o")


def node_counters(outcomes: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Nodes with completed and failed tasks added, and as many current ones taken off, at least none left."""
    done = outcomes.groupBy(node).agg(F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"))
    j = nodes.join(done, node, "left").withColumns({"completed": F.coalesce("completed", F.lit(0)), "failed": F.coalesce("failed", F.lit(0))})
    return j.withColumn("current_tasks", F.greatest(F.lit(0).cast("long"), F.col("current_tasks") - F.col("completed") - F.col("failed")))


# politeness


def gate(requests: DataFrame, most: int) -> DataFrame:
    """Decisions on requests (allowed_by_robots, active, tokens, rate): allowed, wait_time, error.

    Robots rules go first, then the number of requests under way, then a token;
    the lack of one is a time to wait, not an error.
    """
    robots, busy, token = ~F.col("allowed_by_robots"), F.col("active") >= most, F.col("tokens") >= 1
    return requests.withColumns(
        {
            "allowed": ~robots & ~busy & token,
            "wait_time": F.when(robots, 0.0).when(busy, 1.0).when(token, 0.0).otherwise((1 - F.col("tokens")) / F.col("rate")),
            "error": F.when(robots, "disallowed by robots.txt").when(busy, "too many concurrent requests"),
        }
    )


def wait_or_refuse(state: DataFrame, now: Column, timeout: float) -> DataFrame:
    """What a request gets (decision, waited): the first refusal whose wait is over the timeout, else the sum of waits.

    In order: robots rules, backoff, throttle, the required delay.  A timeout of 0 is none.
    """
    left = lambda c: F.greatest(F.lit(0.0), F.col(c) - now)
    over = lambda w: (w > timeout) if timeout else F.lit(False)
    backoff, throttled, delay = left("backoff_until"), F.when(F.col("is_throttled"), left("throttle_until")).otherwise(0.0), F.col("required_delay")
    decision = F.when(~F.col("allowed_by_robots"), "disallowed").when(over(backoff), "backoff").when(over(throttled), "throttled").when((delay > 0) & over(delay), "rate_limited").otherwise("granted")
    return state.withColumn("decision", decision).withColumn("waited", F.when(F.col("decision") == "granted", backoff + throttled + F.greatest(F.lit(0.0), delay)))


# sessions


def rotated(sessions: DataFrame, which: Column, at: Column, key: str = "session_id") -> DataFrame:
    """Sessions with those that ``which`` names replaced by copies of a new id, unused, that say what they come from and when."""
    new = F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), at.cast("string")))
    return sessions.withColumns(
        {"rotated_from": F.when(which, F.col(key).cast("string")), "rotated_at": F.when(which, at), "use_count": F.when(which, 0).otherwise(F.col("use_count")), "new_id": F.when(which, new).otherwise(F.col(key).cast("string"))}
    ).withColumn(key, F.col("new_id")).drop("new_id")


def sealed(rows: DataFrame, columns: Sequence[str], data: str = "data", checksum: str = "checksum") -> DataFrame:
    """Add the row as JSON and its SHA-256."""
    return rows.withColumn(data, F.to_json(F.struct(*columns))).withColumn(checksum, F.sha2(data, 256))


def verified(rows: DataFrame, schema: str, data: str = "data", checksum: str = "checksum", fallback: str | None = None) -> DataFrame:
    """Add ``state``, parsed from data that has its checksum, else from the fallback if that has it, else null, and ``intact``."""
    good = F.when(F.sha2(data, 256) == F.col(checksum), F.col(data))
    if fallback:
        good = F.coalesce(good, F.when(F.sha2(fallback, 256) == F.col(checksum), F.col(fallback)))
    return rows.withColumn("state", F.from_json(good, schema)).withColumn("intact", good.isNotNull())


def set_cookie(header: Column, now: Column) -> Column:
    """A Set-Cookie value as name, value, domain, path, expires, same_site, secure, http_only; null without a name.

    Attributes count in order, so of expires and max-age the last that can be read holds.
    """
    parts = F.split(header, ";")
    first = F.trim(F.get(parts, F.lit(0)))
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.trim(p))
    name_of = lambda p: F.lower(F.trim(F.split(p, "=", 2)[0]))
    value_of = lambda p: F.trim(F.get(F.split(p, "=", 2), F.lit(1)))
    last = lambda name: value_of(F.try_element_at(F.filter(rest, lambda p: (name_of(p) == name) & p.contains("=")), F.lit(-1)))
    flag = lambda name: F.exists(rest, lambda p: F.lower(p) == name)
    stamp = lambda p: F.try_to_timestamp(F.regexp_replace(value_of(p), "^[A-Za-z]+,\\s*|\\s*(GMT|UTC|[+-]0000)$", ""), F.lit("d MMM yyyy HH:mm:ss")).cast("double")
    when = lambda p: F.when(name_of(p) == "expires", stamp(p)).when(name_of(p) == "max-age", now + value_of(p).try_cast("bigint"))
    expires = F.try_element_at(F.filter(F.transform(rest, when), lambda x: x.isNotNull()), F.lit(-1))
    made = F.struct(
        F.split(first, "=", 2)[0].alias("name"), F.get(F.split(first, "=", 2), F.lit(1)).alias("value"), F.coalesce(last("domain"), F.lit("")).alias("domain"), F.coalesce(last("path"), F.lit("/")).alias("path"),
        expires.alias("expires"), F.coalesce(last("samesite"), F.lit("Lax")).alias("same_site"), flag("secure").alias("secure"), flag("httponly").alias("http_only"),
    )
    return F.when(first.contains("="), made)


def proxy(text: Column) -> Column:
    """server, username and password of a proxy address; null if it is none."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/?#@]+)(?::([0-9]+))?(?:[/?#].*)?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    scheme, host, port = F.lower(part(1)), F.lower(part(4)), part(5)
    server = F.concat(scheme, F.lit("://"), host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)))
    fine = scheme.isin(*PROXY_SCHEMES) & (host != "") & ((port == "") | (port.try_cast("int") <= 65535))
    return F.when(fine, F.struct(server.alias("server"), part(2).alias("username"), part(3).alias("password")))


# costs and statistics


def savings(cost: Column) -> Column:
    return F.struct(*((cost * share).alias(name) for name, share in SAVINGS.items()))


def success_stats(rows: DataFrame, keys: Sequence[str], success: str, confidence: str) -> DataFrame:
    """Attempts, successes, their share and the mean confidence of the successful ones."""
    n, ok = F.count("*"), F.count_if(success)
    return rows.groupBy(*keys).agg(n.alias("attempts"), ok.alias("successes"), (ok / n).alias("success_rate"), F.coalesce(F.avg(F.when(F.col(success), F.col(confidence))), F.lit(0.0)).alias("confidence"))
