r"""Robots rules, rate limits and throttle states.

Rules are parsed from text by array functions.  Rate limits and throttles are
folds over a domain's responses in order: composed chunk by chunk in batch (see
``scan``), keyed state with timers in ``docloom.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import scan

#: Moving-average factor, error counts of the two backoffs, bounds and steps of the rate.
ALPHA = 0.1
ERRORS_BACKOFF, ERRORS_BLOCKED = 3, 10
RATE_LOW, RATE_HIGH = 0.1, 10.0


def robots_lines(text: Column) -> Column:
    """(name, value) of each line, comments removed."""
    bare = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    kept = F.filter(bare, lambda x: x.contains(":"))
    return F.transform(kept, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))


def values_of(lines: Column, name: str) -> Column:
    return F.transform(F.filter(lines, lambda x: (x["name"] == name) & (x["value"] != "")), lambda x: x["value"])


def robots(df: DataFrame, text: str) -> DataFrame:
    """Pooled rules: agents, allowed and disallowed paths, delay, rate and sitemaps."""
    out = df.withColumn("_l", robots_lines(F.col(text)))
    line = F.col("_l")
    rate = F.get(values_of(line, "request-rate"), F.lit(0))
    per = F.regexp_extract(rate, r"^(\d+)/(\d+)", 2).try_cast("int")
    return out.withColumns(
        {
            "user_agents": values_of(line, "user-agent"),
            "allowed_paths": values_of(line, "allow"),
            "disallowed_paths": values_of(line, "disallow"),
            "sitemaps": values_of(line, "sitemap"),
            "crawl_delay": F.get(values_of(line, "crawl-delay"), F.lit(0)).try_cast("double"),
            "request_rate": F.when(per > 0, F.regexp_extract(rate, r"^(\d+)/(\d+)", 1).try_cast("int") / per),
        }
    ).drop("_l")


def is_allowed(path: Column, allowed: Column, disallowed: Column) -> Column:
    """By prefixes; an allowed one goes before a disallowed one."""
    yes = F.exists(allowed, lambda p: path.startswith(p))
    no = F.exists(disallowed, lambda p: path.startswith(p))
    return yes | ~no


def wildcard_denies(path: Column, rules: Column) -> Column:
    """Rules with * and a closing $; everything else is literal."""
    literal = lambda p: F.regexp_replace(p, r"([.+?^{}()|\[\]\\])", r"\\$1")
    as_regex = lambda p: F.concat(F.lit("^"), F.regexp_replace(literal(p), r"\*", ".*"))
    return F.exists(rules, lambda p: F.rlike(path, as_regex(p)))


def ema(rows: DataFrame, key: str, value: str, order: list[str], *, size: int = scan.CHUNK) -> DataFrame:
    """Exponential moving average, seeded with the first value; null values change nothing."""
    nothing = scan.affine(F.lit(1), F.lit(0), F.lit(None))
    one = lambda x: F.when(x["v"].isNull(), nothing).otherwise(scan.affine(F.lit(1 - ALPHA), ALPHA * x["v"], x["v"]))
    fold = scan.Fold(nothing, one, scan.affine_then, lambda m, s: m["a"] * s + m["b"])
    cut = scan.chunks(rows, key, order, {"v": F.col(value).cast("double")}, size=size)
    return scan.composed(cut, fold).select(F.col("key").alias(key), F.col("m.seed").alias("ema"))


def _bucket(rate: float, capacity: float) -> tuple[int, int]:
    """(microseconds that a token takes to come back, microseconds that a full bucket is ahead of one token)."""
    every = round(1e6 / rate)
    return every, round((capacity - 1) * every)


def arrival_fold(rate: float, capacity: float) -> scan.Fold:
    """The bucket as the time at which it is full again: a request at t is granted while that is at most ``ahead`` away, and moves it on.

    Times are whole microseconds, so it makes no difference where a history is cut.
    """
    every, ahead = _bucket(rate, capacity)
    one = lambda x: scan.pieces((x["t"], True, x["t"] + every), (x["t"] + ahead, False, every), (x["t"] + ahead + every, False, 0))  # noqa: E731  no earlier request leaves a later state
    return scan.Fold(scan.pieces((scan.HIGH, False, 0)), one, scan.pieces_then, scan.pieces_applied)


def token_bucket(rows: DataFrame, key: str, seconds: str, order: list[str], rate: float, capacity: float, *, size: int = scan.CHUNK) -> DataFrame:
    """(key, granted, waited, tokens): requests that find a token, the seconds that the others are told to wait, and what is left at the last one.

    Requests without a time are left out.
    """
    every, ahead = _bucket(rate, capacity)
    t = F.round(F.col(seconds).cast("double") * 1e6).cast("long")
    cut = scan.chunks(rows.filter(F.col(seconds).isNotNull()), key, order, {"t": t}, size=size)
    met = scan.entries(cut, arrival_fold(rate, capacity), F.lit(scan.LOW + 1))
    start = F.struct(F.col("state").alias("full"), F.lit(0).cast("long").alias("granted"), F.lit(0).cast("long").alias("waited"))

    def step(a: Column, x: Column) -> Column:
        short = a["full"] - x["t"] - ahead
        yes = short <= 0
        return F.struct(F.when(yes, F.greatest(a["full"], x["t"]) + every).otherwise(a["full"]).alias("full"), (a["granted"] + yes.cast("long")).alias("granted"), (a["waited"] + F.when(yes, 0).otherwise(short)).alias("waited"))

    each = met.select("key", "chunk", F.element_at("xs", -1)["t"].alias("t"), F.aggregate("xs", start, step).alias("s"))
    left = (ahead + every - F.greatest(F.lit(0), F.col("s.full") - F.col("t"))) / every
    out = each.groupBy("key").agg(F.sum("s.granted").alias("granted"), (F.sum("s.waited") / 1e6).alias("waited"), F.max_by(left, "chunk").alias("tokens"))
    return out.select(F.col("key").alias(key), "granted", "waited", "tokens")


def waits_of(errors: Column) -> tuple[Column, Column]:
    """(state, backoff) by errors in a row."""
    state = F.when(errors >= ERRORS_BLOCKED, "blocked").when(errors >= ERRORS_BACKOFF, "backoff").otherwise("normal")
    wait = F.when(errors >= ERRORS_BLOCKED, F.least(F.lit(300.0), F.pow(F.lit(2.0), errors - 3))).when(errors >= ERRORS_BACKOFF, F.least(F.lit(60.0), F.pow(F.lit(2.0), errors))).otherwise(0.0)
    return state, wait


def throttle(rows: DataFrame, key: str, order: list[str], status: str = "status_code", *, size: int = scan.CHUNK) -> DataFrame:
    """State, errors in a row, backoff and rate of each domain after its responses in order.

    Errors in a row: from 3 on backoff of 2 ** n seconds up to 60, from 10 on
    blocked with 2 ** (n - 3) up to 300.  The rate is halved by a 429 or 503, cut by a
    tenth by other errors and raised by a tenth by a success, within its bounds.  A
    null status counts as a success.
    """

    def one(x: Column) -> Column:
        bad = x["code"] >= 400
        factor = F.when(x["code"].isin(429, 503), 0.5).when(bad, 0.9).otherwise(1.1)
        return F.struct(scan.run_of(bad, ~bad).alias("errors"), scan.clamp(factor, F.lit(RATE_LOW), F.lit(RATE_HIGH)).alias("rate"))

    nothing = F.struct(scan.run_of(F.lit(False), F.lit(False)).alias("errors"), scan.clamp(F.lit(1), F.lit(0), F.lit(float("inf"))).alias("rate"))
    then = lambda p, q: F.struct(scan.run_then(p["errors"], q["errors"]).alias("errors"), scan.clamp_times(p["rate"], q["rate"]).alias("rate"))
    fold = scan.Fold(nothing, one, then, lambda m, s: s)
    cut = scan.chunks(rows, key, order, {"code": F.coalesce(status, F.lit(200))}, size=size)
    m = F.col("m")
    last = scan.composed(cut, fold).select(F.col("key").alias(key), scan.run_applied(m["errors"], F.lit(0)).cast("int").alias("errors"), scan.held(m["rate"]["by"], m["rate"]).alias("rate"))
    state, wait = waits_of(F.col("errors"))
    return last.select(key, state.alias("state"), "errors", wait.alias("backoff"), "rate")


def required_delay(backoff: Column, throttled: Column, crawl_delay: Column, rate: Column) -> Column:
    """The first that there is of backoff, throttle, crawl delay and 1 / rate."""
    return F.coalesce(F.when(backoff > 0, backoff), F.when(throttled > 0, throttled), F.when(crawl_delay > 0, crawl_delay), F.when(rate > 0, 1 / rate), F.lit(0.0))


def permitted(requests: DataFrame, robots_by_host: DataFrame, url: str = "url") -> DataFrame:
    """Requests with ``allowed`` by the rules of their host; a host without rules allows all.

    Rules have one row a host, so a host with very many requests is a skewed key
    that adaptive execution splits.
    """
    rules = robots_by_host.select(F.col("host").alias("_host"), "allowed_paths", "disallowed_paths")
    j = requests.withColumn("_host", U.host(F.col(url))).join(rules, "_host", "left")
    yes = is_allowed(U.path(F.col(url)), F.col("allowed_paths"), F.col("disallowed_paths"))
    return j.withColumn("allowed", F.coalesce(yes, F.lit(True))).drop("_host", "allowed_paths", "disallowed_paths")


def traffic(results: DataFrame, host: str = "host") -> DataFrame:
    """Requests, blocks, refusals for haste and mean time of each host, and of all (host null)."""
    return results.rollup(host).agg(F.count("*").alias("requests"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("status_code").isin(429, 503)).alias("limited"), F.avg("response_time").alias("avg_response_time"))
