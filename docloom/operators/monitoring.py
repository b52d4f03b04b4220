"""Crawl monitoring: counters, moving statistics, histograms, alerts, cooldowns.

Everything keyed is a grouped aggregate with partial sums, so a crawl with a
third of all results is combined before the shuffle.  Moving frames need order
within a crawl and are windows, of which ``bounded_history`` keeps the last n rows
already before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.state import written

#: Histogram bounds in seconds.
BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
COOLDOWN = 300


def rate(x: Column, n: Column, scale: float = 1.0) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(x * scale / F.nullif(n, F.lit(0)), F.lit(0.0))


def seconds(ts: Column) -> Column:
    """Since 1970, with fractions; for timestamps with and without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def counters(results: DataFrame, keys: Sequence[str] = ("crawl_id",)) -> DataFrame:
    """Counts, mean response time over all results, bytes, distinct URLs and rates of each key."""
    n, ok, bad = F.count("*"), F.count_if("success"), F.count_if("blocked")
    out = results.groupBy(*keys).agg(
        n.alias("requests"), ok.alias("successes"), (n - ok).alias("failures"), bad.alias("blocks"), F.sum("bytes").alias("bytes"), F.avg("response_time").alias("avg_response_time"),
        F.min("response_time").alias("min_response_time"), F.max("response_time").alias("max_response_time"), F.count_distinct("url").alias("urls"), F.max("depth").alias("depth"),
        (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("elapsed"),
    )
    return out.withColumns(
        {"success_rate": rate(F.col("successes"), F.col("requests"), 100.0), "block_rate": rate(F.col("blocks"), F.col("requests"), 100.0), "failure_rate": rate(F.col("failures"), F.col("requests"), 100.0), "requests_per_second": rate(F.col("requests"), F.col("elapsed"))}
    )


def running(results: DataFrame, key: str = "crawl_id", order: Sequence[str] = ("ts", "event_id"), last: int = 100) -> DataFrame:
    """Counters after every result, and the mean of the last ``last`` response times."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumns(
        {"seen": F.count("*").over(upto), "failed": F.sum(F.when(F.col("success"), 0).otherwise(1)).over(upto), "mean_so_far": F.avg("response_time").over(upto), "mean_of_last": F.avg("response_time").over(w.rowsBetween(-(last - 1), 0))}
    )


def within(rows: DataFrame, as_of: Column, minutes: int, ts: str = "ts") -> DataFrame:
    return rows.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(ts) <= as_of))


def bounded_history(rows: DataFrame, key: str, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The last n rows of each key, newest first."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def frequencies(results: DataFrame, key: str, by: str) -> DataFrame:
    return results.filter(F.col(by).isNotNull()).groupBy(key, by).agg(F.count("*").alias("n"))


def labelled(results: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts of every combination of labels, with subtotals and the total."""
    return results.rollup(*labels).agg(F.count("*").alias("n"), F.grouping_id(*labels).alias("level"))


def histogram(results: DataFrame, key: str = "crawl_id", value: str = "response_time") -> DataFrame:
    """Cumulative counts by upper bound, +Inf last."""
    counts = results.groupBy(key).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)), F.count(value).alias("inf"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n"))]
    return counts.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.le", "x.n")


def summary(per_crawl: DataFrame) -> DataFrame:
    """All crawls: totals, and the mean of the crawls' own rates."""
    return per_crawl.agg(F.count("*").alias("crawls"), F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.avg("success_rate").alias("avg_success_rate"))


#: Rule lists: name, condition over a metric row, severity, message.
RULES_A = (("low_success", "success_rate < 80", "warning", "success rate is low"), ("high_block", "block_rate > 30", "critical", "block rate is high"), ("slow", "requests > 10 AND avg_response_time > 10", "warning", "responses are slow"))
RULES_B = (("failures", "failure_rate > 20", "warning", "more than 20 % failures"), ("blocks", "block_rate > 10", "critical", "more than 10 % blocks"), ("slow", "avg_response_time > 5", "info", "more than 5 s on average"))
RULES_C = (
    ("high_cpu", "cpu_percent > 90", "warning", "processor load is high"), ("high_memory", "memory_percent > 85", "warning", "memory is nearly full"),
    ("blocks", "status = 'running' AND block_rate > 30 AND requests > 10", "critical", "blocked"), ("slow", "status = 'running' AND avg_response_time > 10 AND requests > 5", "warning", "slow"),
)
#: Of the host: with the thresholds of list A, and on their own.
RULES_HOST_A = (("high_cpu", "cpu_percent > 80", "warning", "processor load is high"), ("high_memory", "memory_percent > 85", "warning", "memory is nearly full"))
RULES_SYSTEM = (("high_memory", "memory_percent > 90", "critical", "memory is nearly full"), ("high_cpu", "cpu_percent > 80", "warning", "processor load is high"))


def alerts(metrics: DataFrame, rules: Sequence[tuple[str, str, str, str]], key: str = "crawl_id") -> DataFrame:
    """A row for each rule that a metric row meets; rules are SQL conditions."""
    made = [F.when(F.expr(cond), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for name, cond, severity, message in rules]
    return metrics.select(key, F.explode(F.array_compact(F.array(*made))).alias("x")).select(key, "x.*")


#: Times of a key that are one row of ``cooldown``.
RUN = 1 << 13


def _first(times: np.ndarray, last: int | None, wait: int) -> int:
    """The place of the first of ``times`` that is sent after ``last``."""
    return 0 if last is None else int(np.searchsorted(times, last + wait))


def _runs(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted rows (key, t): a row (key, first, ts) for at most ``size`` different times of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = np.empty(0, np.int64), None  # of the last key, which may go on in the next batch

        def rows(times: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(times), size):
                ts = times[at : at + size]
                yield pa.RecordBatch.from_arrays([key, pa.array(ts[:1]), pa.ListArray.from_arrays(pa.array([0, len(ts)], pa.int32()), pa.array(ts))], ["key", "first", "ts"])

        for b in batches:
            ends, at = pc.run_end_encode(b.column(0)), 0
            times = b.column(1).to_numpy(zero_copy_only=False)
            for i, end in enumerate(ends.run_ends.to_pylist()):
                k, own = ends.values.slice(i, 1), times[at:end]
                at = end
                if key is None or not key.equals(k):
                    yield from rows(held)
                    held, key = own[:0], pa.array(k.to_pylist(), k.type)
                new = np.unique(np.concatenate([held[-1:], own]))[len(held[-1:]) :]
                held = np.concatenate([held, new])
                full = (len(held) - 1) // size * size  # one stays, for the next batch may begin with the same time
                yield from rows(held[:full])
                held = held[full:]
        yield from rows(held)

    return run


def _steps(wait: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each run does: if the last alert was sent so long before that ``upto`` is over, the run's last one is sent at ``sent``; beyond all, none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                n, sent = len(t), t.copy()
                after = np.searchsorted(t, t + wait)
                while (open_ := after < n).any():  # each jump to the next one sent, for all at once, twice as far each time
                    sent[open_] = sent[after[open_]]
                    after[open_] = after[after[open_]]
                begin = np.arange(min(n, int(np.searchsorted(t, t[0] + wait)) + 1))
                last = begin[np.append(sent[begin[1:]] != sent[begin[:-1]], True)]  # of those that end alike
                lists = [pa.ListArray.from_arrays(pa.array([0, len(last)], pa.int32()), pa.array(x[last])) for x in (t, sent)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *lists], ["key", "first", "upto", "sent"])

    return run


def _states(wait: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, first, last) of runs sorted by key: the last alert sent before each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, begun = None, None, False
        for b in batches:
            out = []
            for i, k in enumerate(b.column(0).to_pylist()):
                if not begun or k != key:
                    key, last, begun = k, None, True
                out.append(last)
                upto, sent = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                at = _first(upto, last, wait)
                last = int(sent[at]) if at < len(upto) else last
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["key", "first", "last"])

    return run


def _sent(wait: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, t) of the alerts of runs (key, ts, last) that are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, last in enumerate(b.column(2).to_pylist()):
                t, places = b.column(1)[i].values.to_numpy(zero_copy_only=False), []
                at = _first(t, last, wait)
                while at < len(t):
                    places.append(at)
                    at = _first(t, int(t[at]), wait)
                if places:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(places))), pa.array(t[places])], ["key", "t"])

    return run


def cooldown(rows: DataFrame, key: str, ts: str = "ts", hold: float = COOLDOWN, *, size: int = RUN) -> DataFrame:
    """(key, sent_at) of the alerts that are sent: an alert holds back later ones of its key for ``hold`` seconds.

    The state is the last time sent, in microseconds.  Times are range-partitioned and sorted
    by key and time, so that a key with very many lies in many tasks, and cut into runs of at
    most ``size``, written to the shared checkpoint folder.  What a run does to the state is
    looked up among its first alerts, those within ``hold`` of the first; a key's runs are gone
    through by these, in order, where it has several, and each run then sends on its own.
    Work grows with the rows, however many of them are within ``hold``.  Alerts without a time
    are left out.
    """
    wait = max(round(hold * 1e6), 1)  # different times are a microsecond apart
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    times = rows.select(F.col(key).alias("key"), t.alias("t")).filter("t IS NOT NULL")
    kind = times.schema["key"].dataType.simpleString()
    dealt = times.repartitionByRange("key", "t").sortWithinPartitions("key", "t")
    runs = written(dealt.mapInArrow(_runs(size), f"key {kind}, first long, ts array<long>"))
    several = runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"))
    again = runs.join(several, F.col("key").eqNullSafe(F.col("k")), "left_semi")
    steps = again.mapInArrow(_steps(wait), f"key {kind}, first long, upto array<long>, sent array<long>")
    states = steps.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_states(wait), f"key {kind}, first long, last long")
    states = states.select(F.col("key").alias("k"), F.col("first").alias("f"), "last")
    met = runs.join(states, F.col("key").eqNullSafe(F.col("k")) & (F.col("first") == F.col("f")), "left").select("key", "ts", "last")
    return met.mapInArrow(_sent(wait), f"key {kind}, t long").select(F.col("key").alias(key), F.timestamp_micros("t").alias("sent_at"))


def let_through(rows: DataFrame, key: str, order: str, ts: str = "ts", *, ttl: float) -> DataFrame:
    """(key, ts, order): the rows of a filter that forgets a key ``ttl`` seconds after it let it through; of rows of one time the first."""
    sent = cooldown(rows, key, ts, ttl).select(F.col(key).alias("_key"), F.col("sent_at").alias("_at"))
    first = rows.groupBy(key, F.col(ts).cast("timestamp").alias(ts)).agg(F.min(order).alias(order))
    return first.join(sent, F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts) == F.col("_at"))).select(key, ts, order)


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last state of each key, by an aggregate."""
    rest = [c for c in rows.columns if c != key]
    last = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("x")
    return rows.groupBy(key).agg(last).select(key, "x.*").select(*rows.columns)


def exposition(per_crawl: DataFrame, metrics: Sequence[str], key: str = "crawl_id", prefix: str = "crawl_") -> DataFrame:
    """Lines of the text exposition format."""
    lines = [F.format_string(f'{prefix}{m}{{{key}="%s"}} %s', F.col(key), F.col(m).cast("string")) for m in metrics]
    return per_crawl.select(F.explode(F.array(*lines)).alias("line"))


def finished_rate(per_crawl: DataFrame) -> DataFrame:
    """The mean success rate of crawls that are completed or failed and have requests; 0 without any."""
    done = per_crawl.filter(F.col("status").isin("completed", "failed") & (F.col("requests") > 0))
    return done.agg(F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("avg_success_rate"))


def url_counters(results: DataFrame, key: str = "crawl_id") -> DataFrame:
    """Counts of results and of distinct URLs of each key; failures count as blocked by their text or status, bytes and statuses of successes alone."""
    failed = ~F.col("success")
    blocked = failed & (F.coalesce(F.lower("error").contains("blocked"), F.lit(False)) | F.col("status_code").isin(403, 429))
    base = results.groupBy(key).agg(
        F.count("*").alias("requests"), F.count_distinct("url").alias("urls_crawled"), F.count_distinct(F.when(failed, F.col("url"))).alias("urls_failed"), F.count_if(blocked).alias("blocked"),
        F.count_distinct(F.when(blocked, F.col("url"))).alias("urls_blocked"), F.coalesce(F.sum(F.when(F.col("success"), F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    codes = results.filter("success").groupBy(key, "status_code").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status_code", "n")))).alias("status_codes"))
    return base.join(codes, key, "left")


def counted(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(kind, value, n): how often each value of each column occurs, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))
    return results.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def log_levels(lines: DataFrame, line: str) -> DataFrame:
    """(level, n) of log lines with a level in capitals; others are left out."""
    level = F.regexp_extract(line, r"\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b", 1)
    return lines.select(level.alias("level")).filter("level <> ''").groupBy("level").agg(F.count("*").alias("n"))
