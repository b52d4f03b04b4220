r"""Ordered folds on streams, by keyed state with timers.

Each is the fold that the batch operator of the same name composes chunk by chunk
(``politeness.token_bucket``, ``extensions.error_backoff``, ``monitoring.cooldown``).
A key's rows of a micro-batch are put in order of time and folded from the state that
the micro-batches before have left; what a key has in one micro-batch is held by one
task, which the source's limits on a trigger bound.  Rows must not come later than the
watermark, and a key's rows of one micro-batch not before those of an earlier one.

State goes away by an event-time timer, ``idle`` after a key's last row.  A bucket is
full again and a cooldown over by then, so forgetting them changes nothing; errors in
a row are forgotten, which the batch fold does not do.  Rows without a time are left
out.  State is held in RocksDB: the functions set
``spark.sql.streaming.stateStore.providerClass`` in the session if it is unset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators import politeness

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Folded(StatefulProcessor):
    """Folds each key's rows in order of ``t`` (microseconds); the state is a tuple of ``schema``, cleared ``idle`` seconds after the last row."""

    def __init__(self, key: str, schema: str, start: tuple, fold: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]], idle: float):
        self.key, self.schema, self.start, self.fold, self.idle = key, schema, start, fold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("t", kind="stable")
        before = tuple(self.state.get()) if self.state.exists() else self.start
        after, out = self.fold(before, own)
        self.state.update(after)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(own["t"].iloc[-1] // 1000 + self.idle * 1000) + 1)
        out.insert(0, self.key, key[0])
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _folded(stream: DataFrame, key: str, ts: str, late: str, fields: dict[str, str], made: str, mode: str, *, schema: str, start: tuple, fold: Callable, idle: float) -> DataFrame:
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)
    timed = stream.filter(F.col(ts).isNotNull()).select(F.col(key).alias(key), F.col(ts).cast("timestamp").alias("ts"), *(F.expr(e).alias(k) for k, e in fields.items()))
    rows = timed.withColumn("t", F.unix_micros("ts")).withWatermark("ts", late)
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Folded(key, schema, start, fold, idle), f"{key} {kind}, {made}", mode, "EventTime")


def _bucket_step(state: tuple, own: pd.DataFrame, every: int, ahead: int) -> tuple[tuple, pd.DataFrame]:
    full, out = state[0], []
    for t in own["t"]:
        short = full - t - ahead if full is not None else 0
        if short <= 0:
            full = max(full, t) + every if full is not None else t + every
        out.append((pd.Timestamp(t, unit="us"), short <= 0, max(short, 0) / 1e6))
    return (int(full),), pd.DataFrame(out, columns=["ts", "granted", "waited"])


def token_bucket(stream: DataFrame, key: str, ts: str = "ts", *, rate: float, capacity: float, late: str = "10 minutes") -> DataFrame:
    """(key, ts, granted, waited) of every request: whether it finds a token, and else the seconds it is told to wait."""
    every, ahead = politeness._bucket(rate, capacity)
    step = partial(_bucket_step, every=every, ahead=ahead)
    return _folded(stream, key, ts, late, {}, "ts timestamp, granted boolean, waited double", "append", schema="full long", start=(None,), fold=step, idle=capacity / rate)


def _backoff_step(state: tuple, own: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    errors, backoff = state
    for code, after in zip(own["code"], own["after"], strict=True):
        limited = code in (429, 503)
        errors = errors + 1 if limited or code >= 500 else 0 if code < 400 else errors
        if limited:
            backoff = float(after) if pd.notna(after) else min(300.0, 2.0**errors)
        elif code < 400:
            backoff = 0.0
    return (int(errors), backoff), pd.DataFrame({"errors": [errors], "backoff": [backoff], "throttled": [60.0 if errors >= 3 else 0.0]})


def error_backoff(stream: DataFrame, key: str, ts: str = "ts", status: str = "status_code", retry_after: str | None = None, *, idle: float = 86_400, late: str = "10 minutes") -> DataFrame:
    """(key, errors, backoff, throttled) of each key after every micro-batch that has rows of it.  Rows without a status are left out."""
    fields = {"code": f"`{status}`", "after": f"CAST({f'`{retry_after}`' if retry_after else 'NULL'} AS DOUBLE)"}
    return _folded(stream.filter(F.col(status).isNotNull()), key, ts, late, fields, "errors int, backoff double, throttled double", "update", schema="errors int, backoff double", start=(0, 0.0), fold=_backoff_step, idle=idle)


def _cooldown_step(state: tuple, own: pd.DataFrame, hold: int) -> tuple[tuple, pd.DataFrame]:
    last, sent = state[0], []
    for t in own["t"]:
        if last is None or t - last >= hold:
            last = int(t)
            sent.append(pd.Timestamp(last, unit="us"))
    return (last,), pd.DataFrame({"sent_at": pd.Series(sent, dtype="datetime64[us]")})


def cooldown(stream: DataFrame, key: str, ts: str = "ts", *, hold: float = 300, late: str = "10 minutes") -> DataFrame:
    """(key, sent_at) of the alerts that are sent: one holds back later ones of its key for ``hold`` seconds."""
    return _folded(stream, key, ts, late, {}, "sent_at timestamp", "append", schema="last long", start=(None,), fold=partial(_cooldown_step, hold=round(hold * 1e6)), idle=hold)
