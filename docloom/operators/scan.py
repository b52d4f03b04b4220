r"""Folds over the rows of a key in order, without a key's history in one place.

A fold that depends on order is written as a *transition*, a small value that says
what a stretch of rows does to whatever state it meets.  Transitions of
neighbouring stretches compose, so a key's rows are dealt like any others:

1. Rows are range-partitioned and sorted by key and order, so that a key with very many
   rows lies in many partitions, and cut into chunks of bounded length, which
   are written to the shared checkpoint folder.
2. Each chunk is reduced to its transition.
3. The transitions of a partition are composed, then those of a key's partitions.
   What meets in one task is a value for each chunk of a partition, or for each
   partition of a key, never the rows.
4. Where each row's decision is wanted, the state before every chunk is known by
   then, and the chunks are folded once more, each on its own.

Rows without order columns that differ are in no stated order among themselves.
A null key is a key of its own.  An empty table gives no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.state import written

#: Rows of a chunk.
CHUNK = 1024


class Fold(NamedTuple):
    """A fold over rows: what nothing does, what one row does, what two stretches do one after the other, what a stretch does to a state."""

    nothing: Column
    one: Callable[[Column], Column]
    then: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]


def chunks(rows: DataFrame, key: str, order: Sequence[str], fields: dict[str, Column], *, size: int = CHUNK) -> DataFrame:
    """(key, part, chunk, xs): the fields of at most ``size`` rows of a key in order; chunks of a key are numbered in order."""
    rank = {f"o{i}": F.col(c) for i, c in enumerate(order)}
    dealt = rows.select(F.col(key).alias("key"), *(c.alias(k) for k, c in rank.items()), F.struct(*(c.alias(k) for k, c in fields.items())).alias("x"))
    dealt = dealt.repartitionByRange("key", *rank).sortWithinPartitions("key", *rank)
    at = F.monotonically_increasing_id()  # the partition's number, then the row's place in it
    placed = dealt.select("key", F.spark_partition_id().alias("part"), at.alias("at"), "x")
    chunk = F.floor(F.col("at") / size).alias("chunk")
    xs = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda r: r["x"])
    return written(placed.groupBy("key", "part", chunk).agg(xs.alias("xs")))


def summaries(chunked: DataFrame, fold: Fold) -> DataFrame:
    """(key, part, ms, m): the transitions of the chunks of a key in a partition, and all of them as one."""
    of_chunk = F.aggregate("xs", fold.nothing, lambda a, x: fold.then(a, fold.one(x)))
    each = chunked.select("key", "part", "chunk", of_chunk.alias("m"))
    ms = F.sort_array(F.collect_list(F.struct("chunk", "m")))
    return each.groupBy("key", "part").agg(ms.alias("ms")).withColumn("m", _composed("ms", fold))


def _composed(ms: str, fold: Fold) -> Column:
    return F.aggregate(ms, fold.nothing, lambda a, x: fold.then(a, x["m"]))


def composed(chunked: DataFrame, fold: Fold) -> DataFrame:
    """(key, m): the transition of all rows of each key."""
    ms = F.sort_array(F.collect_list(F.struct("part", "m")))
    return summaries(chunked, fold).groupBy("key").agg(ms.alias("ms")).select("key", _composed("ms", fold).alias("m"))


def entries(chunked: DataFrame, fold: Fold, start: Column) -> DataFrame:
    """The chunks with ``state``, the state before them; every key begins with ``start``."""
    parts = written(summaries(chunked, fold))

    def before(ms: str, place: str, first: Column) -> Column:
        empty = F.filter(F.array(F.struct(F.col(f"{ms}.{place}")[0].alias(place), first.alias("state"))), lambda _: F.lit(False))
        run = F.aggregate(ms, F.struct(first.alias("state"), empty.alias("out")), lambda a, x: F.struct(fold.apply(x["m"], a["state"]).alias("state"), F.array_append(a["out"], F.struct(x[place].alias(place), a["state"].alias("state"))).alias("out")))
        return F.explode(run["out"])

    of_part = parts.select("key", "part", "m").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("ms"))
    of_part = of_part.select("key", before("ms", "part", start).alias("s")).select(F.col("key").alias("k"), F.col("s.part").alias("p"), F.col("s.state").alias("first"))
    met = parts.join(of_part, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    of_chunk = met.select("key", before("ms", "chunk", F.col("first")).alias("s")).select(F.col("key").alias("k"), F.col("s.chunk").alias("c"), F.col("s.state").alias("state"))
    return chunked.join(of_chunk, F.col("key").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("c"))).select("key", "chunk", "xs", "state")


# transitions


def affine(a: Column, b: Column, seed: Column) -> Column:
    """x becomes a * x + b; no state becomes the seed."""
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), seed.cast("double").alias("seed"))


def affine_then(p: Column, q: Column) -> Column:
    return affine(p["a"] * q["a"], q["a"] * p["b"] + q["b"], F.when(p["seed"].isNull(), q["seed"]).otherwise(q["a"] * p["seed"] + q["b"]))


def clamp(by: Column, low: Column, high: Column) -> Column:
    """x becomes x * by, or x + by, and is then held between low and high."""
    return F.struct(by.cast("double").alias("by"), low.cast("double").alias("low"), high.cast("double").alias("high"))


def held(x: Column, m: Column) -> Column:
    return F.greatest(m["low"], F.least(m["high"], x))


def clamp_times(p: Column, q: Column) -> Column:
    """One factor after another.  Beyond a factor of a million all states of an interval that narrow have met, and the bounds say it all."""
    by = F.greatest(F.lit(1e-6), F.least(F.lit(1e6), p["by"] * q["by"]))
    return clamp(by, held(p["low"] * q["by"], q), held(p["high"] * q["by"], q))


def clamp_plus(p: Column, q: Column) -> Column:
    return clamp(p["by"] + q["by"], held(p["low"] + q["by"], q), held(p["high"] + q["by"], q))


def run(reset: Column, n: Column, lead: Column, reached: Column) -> Column:
    """A count of rows in a row: whether it began anew, its length since, its length before that, and whether one in between was long enough."""
    return F.struct(reset.cast("boolean").alias("reset"), n.cast("long").alias("n"), lead.cast("long").alias("lead"), reached.cast("boolean").alias("reached"))


def run_of(hit: Column, clear: Column) -> Column:
    n = F.when(hit, 1).otherwise(0)
    return run(clear, n, n, F.lit(False))


def run_then(p: Column, q: Column, enough: int = 1 << 40) -> Column:
    return run(
        p["reset"] | q["reset"],
        F.when(q["reset"], q["n"]).otherwise(p["n"] + q["n"]),
        F.when(p["reset"], p["lead"]).otherwise(p["lead"] + q["lead"]),
        p["reached"] | q["reached"] | (p["reset"] & (p["n"] + q["lead"] >= enough)),
    )


def run_applied(m: Column, n: Column) -> Column:
    return F.when(m["reset"], m["n"]).otherwise(n + m["n"])


#: Ends of the range of states of ``pieces``, far from every time in microseconds.
LOW, HIGH = -(1 << 61), 1 << 61


def piece(low: Column, high: Column, fixed: bool | Column, v: Column) -> Column:
    """For states over ``low`` up to ``high``: they become v, or v is added to them."""
    fixed = F.lit(fixed) if isinstance(fixed, bool) else fixed
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), fixed.alias("fixed"), v.cast("long").alias("v"))


def pieces(*parts: tuple[Column | int, bool, Column | int]) -> Column:
    """An array of pieces from (high, fixed, v), each beginning where the one before ends."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    lows = [F.lit(LOW), *(col(h) for h, _, _ in parts[:-1])]
    return F.array(*(piece(low, col(h), fixed, col(v)) for low, (h, fixed, v) in zip(lows, parts, strict=True)))


def pieces_applied(m: Column, x: Column) -> Column:
    p = F.filter(m, lambda p: (p["low"] < x) & (x <= p["high"]))[0]
    return F.when(p["fixed"], p["v"]).otherwise(x + p["v"])


def pieces_then(p: Column, q: Column) -> Column:
    """Pieces of both, one after the other; neighbours that do the same are one piece."""

    def cut(a: Column) -> Column:
        shifted = F.transform(q, lambda b: piece(F.greatest(a["low"], b["low"] - a["v"]), F.least(a["high"], b["high"] - a["v"]), b["fixed"], F.when(b["fixed"], b["v"]).otherwise(a["v"] + b["v"])))
        whole = F.array(piece(a["low"], a["high"], a["fixed"], pieces_applied(q, a["v"])))
        return F.when(a["fixed"], whole).otherwise(F.filter(shifted, lambda b: b["low"] < b["high"]))

    def joined(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        same = (F.size(done) > 0) & (last["fixed"] == b["fixed"]) & (last["v"] == b["v"])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(piece(last["low"], b["high"], b["fixed"], b["v"])))
        return F.when(same, longer).otherwise(F.concat(done, F.array(b)))

    all_ = F.flatten(F.transform(p, cut))
    return F.aggregate(all_, F.slice(all_, 1, 0), joined)
