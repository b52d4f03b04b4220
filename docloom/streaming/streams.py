"""Structured Streaming forms of monitoring, politeness and dedup.

All take and return streaming DataFrames.  Event time and watermarks are an
addition: the batch operators order by arrival or by the time column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counters(stream: DataFrame, key: str = "crawl_id", ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, failures and mean response time of each key and window."""
    made = stream.withWatermark(ts, late).groupBy(F.window(ts, window), key)
    return made.agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failures"), F.avg("response_time").alias("avg_response_time")).select(F.col("window.start").alias("start"), key, "requests", "failures", "avg_response_time")


def first_seen(stream: DataFrame, key: str, ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """The first row of each key within its time to live; keys are forgotten after it."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def cooldown(stream: DataFrame, key: str = "crawl_id", ts: str = "ts", seconds: int = 300) -> DataFrame:
    """Alerts that are sent: the state of a key is the last time sent."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t.timestamp() for b in batches for t in b[ts])
        out = []
        for t in times:
            if last is None or t - last >= seconds:
                last = t
                out.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(out), "sent_at": out})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, sent_at double", "last double", "append", GroupStateTimeout.NoTimeout)


def throttle(stream: DataFrame, key: str = "domain", order: str = "event_id", status: str = "status_code") -> DataFrame:
    """Errors in a row, backoff and rate of a domain after each micro-batch, as ``politeness.throttle`` has them."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, rate = state.get if state.exists else (0, 1.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for code in rows[status]:
            errors = errors + 1 if code >= 400 else 0
            rate = max(0.1, min(10.0, rate * (0.5 if code in (429, 503) else 0.9 if code >= 400 else 1.1)))
        state.update((int(errors), float(rate)))
        backoff = min(300.0, 2.0 ** (errors - 3)) if errors >= 10 else min(60.0, 2.0**errors) if errors >= 3 else 0.0
        yield pd.DataFrame({key: [name[0]], "errors": [errors], "backoff": [backoff], "rate": [rate]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, errors int, backoff double, rate double", "errors int, rate double", "update", GroupStateTimeout.NoTimeout)
