r"""SimHash near-duplicates by bit-sliced comparison (operator 2).

* Fingerprints: a bit is 1 if set in over half of the XXH64 values (seed 42) of
  a text's word shingles, repeats included.
* Equal fingerprints are one node.  With ``r`` differing bits at most, of
  ``r + 6`` blocks of a fingerprint at least six are equal, so rows are dealt out
  by every choice of six blocks.  For r = 2 that makes 28 keys of 48 bits, and a
  key can have no more than 65,536 distinct fingerprints, whatever the data.
* Inside a key the bit planes of the fingerprints are stored vertically, 64
  fingerprints to a word.  Planes update the distances of all pairs with
  carry-save counters; blocks whose distances all exceed the radius are left at
  once.  A breadth-first search over these comparisons returns a spanning tree
  of each group, not its pairs.
* Components come from ``components``.  No link is lost.

Null and empty texts have the fingerprint 0 and are linked like any other.  Null
ids are never a component's name unless it has no other.  Repeated rows give
repeated results; an empty table an empty one.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from docloom.llm.common import free_name, row_key, small_batches, table, with_fields, written
from docloom.llm.components import components

RADIUS = 2
SHINGLE = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
_SLICE = 1 << 14


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def shingle_hashes(ws: list[bytes], q: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if not ws:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(ws[i:] for i in range(q)), strict=False)) if len(ws) >= q else [b" ".join(ws)]
    return np.fromiter((xxh64_intdigest(x, 42) for x in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        counts += np.unpackbits(hashes[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(words(x), shingle)) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, with_fields(docs.select("doc_id").schema, fp=LongType()))


def block_masks(radius: int) -> list[int]:
    """The bits of every choice of six of radius + 6 blocks."""
    n = radius + 6
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(n)]
    return [sum(c) for c in combinations(blocks, 6)]


_ALL, _NONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)


class Planes:
    """Fingerprints of one key, bit by bit: plane p holds bit p of all, 64 to a word."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.n = fps, radius, len(fps)
        words_ = -(-self.n // 64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        varied = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))  # planes of equal bits add nothing
        padded = np.zeros((len(varied), words_ * 64), np.uint8)
        padded[:, : self.n] = bits[:, varied].T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.own = bits[:, varied].astype(bool)

    def near(self, queries: np.ndarray, among: np.ndarray) -> np.ndarray:
        """For each query, a bit for each fingerprint of ``among`` (a mask by words) within the radius."""
        held = np.flatnonzero(among)  # blocks of 64 that are still of interest
        mask = among[held]
        counters = np.zeros((self.radius.bit_length() + 1, len(queries), len(held)), np.uint64)  # the last one: too many
        for p in range(len(self.planes)):
            flip = np.where(self.own[queries, p], _ALL, _NONE)[:, None]
            carry = self.planes[p][held][None, :] ^ flip
            for c in counters[:-1]:
                carry, c[...] = c & carry, c ^ carry
            counters[-1] |= carry
            if p >= self.radius:
                some = (self._within(counters) & mask).any(axis=0)
                if not some.any():
                    break
                if some.sum() * 2 < len(held):  # abandon blocks in which all exceed the radius
                    held, mask, counters = held[some], mask[some], counters[:, :, some]
        out = np.zeros((len(queries), len(among)), np.uint64)
        out[:, held] = self._within(counters) & mask
        return out

    def _within(self, counters: np.ndarray) -> np.ndarray:
        """Counters of no more than the radius, compared from the highest bit."""
        less, same = np.zeros_like(counters[0]), ~counters[-1]
        for bit in reversed(range(len(counters) - 1)):
            if self.radius >> bit & 1:
                less |= same & ~counters[bit]
                same = same & counters[bit]
            else:
                same = same & ~counters[bit]
        return less | same

    def tree(self) -> list[tuple[int, int]]:
        """Index pairs that span every group of fingerprints linked within the radius."""
        left = np.packbits(np.arange(-(-self.n // 64) * 64) < self.n, bitorder="little").view(np.uint64).copy()
        out: list[tuple[int, int]] = []
        for start in range(self.n):
            if not left[start >> 6] >> np.uint64(start & 63) & np.uint64(1):
                continue
            left[start >> 6] &= ~(np.uint64(1) << np.uint64(start & 63))
            front = np.array([start])
            while len(front):
                new = []
                for i in range(0, len(front), 128):
                    hits = self.near(front[i : i + 128], left)
                    for q, row in zip(front[i : i + 128], hits, strict=True):
                        row &= left
                        left &= ~row
                        at = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
                        out += [(int(q), int(x)) for x in at]
                        new.append(at)
                front = np.concatenate(new)
        return out


def links(nodes: DataFrame, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints that span every group within the radius."""
    masks = block_masks(radius)
    keys = F.array(*(F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks))
    return _compared(nodes.select(F.col(fp).alias("fp"), F.col(fp).alias("node"), F.posexplode(keys).alias("t", "key")), radius)


def _compared(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b): nodes linked in rows (fp, node, t, key), compared inside each (t, key)."""
    small_batches(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            fps, node, t, key = (b.column(i).to_numpy().astype(np.int64) for i in range(4))
            groups = np.split(np.stack([fps, node]), np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1, axis=1)
            if last is not None and last != (t[0], key[0]):
                yield from _linked([np.concatenate(held, axis=1)], radius)
                held = []
            held.append(groups[0])
            if len(groups) > 1:
                yield from _linked([np.concatenate(held, axis=1), *groups[1:-1]], radius)
                held = [groups[-1]]
            last = (t[-1], key[-1])
        if held:
            yield from _linked([np.concatenate(held, axis=1)], radius)

    rows = dealt.select("fp", "node", "t", "key").repartition("t", "key").sortWithinPartitions("t", "key", "node")
    return rows.mapInArrow(run, "a long, b long")


def _linked(groups: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for fps, node in groups:
        if len(fps) == 2:  # a block of one pair
            x = fps.view(np.uint64)
            if np.bitwise_count(x[0] ^ x[1]) <= radius:
                a.append(node[0])
                b.append(node[1])
        elif len(fps) > 2:
            for i, j in Planes(np.ascontiguousarray(fps).view(np.uint64), radius).tree():
                a.append(node[i])
                b.append(node[j])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Fingerprints and components that a large share of the rows has are skewed
    keys of joins whose other side has one row a key and is written before, so
    that adaptive execution splits them.
    """
    fps = written(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = written(rooted.join(named, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: For near copies: shingles of five words, and a SimHash similarity (1 - distance / 64) of 0.8 or more.
COPY_SHINGLE, COPY_RADIUS = 5, 12
#: Shingle minima of a text; two make a key.
MINIMA = 32
#: Nodes of a key over which it is compared in parts, and those that every part of it has in common.
CROWDED, COMMON = 32_768, 64
_SEEDS = np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least shingle hash under each of several orders, mixed anew for each so that they are independent."""
    out = np.zeros(MINIMA, np.uint64)
    if not len(hashes):
        return out
    for i, seed in enumerate(_SEEDS):  # the finaliser of SplitMix64
        x = hashes ^ seed
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        out[i] = x.min()
    return out


def _grouped(dealt: DataFrame, radius: int) -> DataFrame:
    """(node, root) as of ``components``, of rows (fp, node, t, key) that are all compared inside each (t, key).

    Keys of more than ``CROWDED`` nodes are compared in parts that have some nodes
    in common, then every node that is not in the key's largest group so far with
    all of the key, part against part.  So no task has a whole crowded key, and no
    pair of it is left out; nodes of the largest group are linked already.
    """
    sizes = written(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED))
    if sizes.isEmpty():
        return components(_compared(dealt, radius))
    half = CROWDED // 2
    part = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col(n) / half))
    plain = dealt.join(sizes, ["t", "key"], "left_anti").select("fp", "node", "t", "key")
    crowded = written(dealt.join(sizes, ["t", "key"]))
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / half) - 1)
    common = F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")) < COMMON
    first = crowded.select("fp", "node", "t", "key", F.explode(F.when(common, parts).otherwise(F.array(part(1, "n")))).alias("i"))
    roots = components(_compared(plain.unionByName(first.select("fp", "node", F.lit(-1).alias("t"), F.xxhash64("t", "key", "i").alias("key"))), radius))

    rooted = written(crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    most = written(rooted.groupBy("t", "key", "root").agg(F.count("*").alias("k")).groupBy("t", "key").agg(F.max(F.struct("k", "root")).alias("x")))
    rooted = written(rooted.join(most, ["t", "key"]).withColumn("other", F.col("n") - F.col("x.k")).filter("other > 0").withColumn("rest", F.col("root") != F.col("x.root")))
    if rooted.isEmpty():
        return roots
    # part i of the rest of a key against part j of the whole
    others = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("other") / half) - 1)
    whole = rooted.select("fp", "node", "t", "key", F.explode(others).alias("i"), part(1, "n").alias("j"))
    rest = rooted.filter("rest").select("fp", "node", "t", "key", part(3, "other").alias("i"), F.explode(parts).alias("j"))
    again = _compared(whole.unionByName(rest).select("fp", "node", F.lit(-2).alias("t"), F.xxhash64("t", "key", "i", "j").alias("key")), radius)
    return components(again.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def copy_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = COPY_SHINGLE, radius: int = COPY_RADIUS) -> DataFrame:
    """(k1, k2, doc_id, group): near copies share a group; (k1, k2) is ``row_key(doc_id, text)``.

    A radius of 12 bits has no selective exact blocks, so texts are compared if
    two of their shingle minima agree at one of sixteen places: a pair of shingle
    Jaccard similarity s is missed with a probability of (1 - s^2)^16.  Inside a
    key the fingerprints are compared bit by bit as above, against ``radius``.
    """
    small_batches(docs.sparkSession)
    k1, k2 = row_key(doc_id, text)
    docs = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, least = [], []
            for x in b.column(3).to_pylist():
                h = shingle_hashes(words(x), shingle)
                fps.append(fingerprint(h))
                least.append(minima(h))
            flat = np.concatenate(least).view(np.int64) if least else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, MINIMA, dtype=np.int32)), pa.array(flat))], ["k1", "k2", "doc_id", "fp", "least"])

    kinds = with_fields(docs.select("k1", "k2", "doc_id").schema, fp=LongType(), least=ArrayType(LongType()))
    pairs = F.array(*(F.xxhash64(F.get("least", F.lit(2 * i)), F.get("least", F.lit(2 * i + 1)), F.lit(i)) for i in range(MINIMA // 2)))
    made = written(docs.mapInArrow(run, kinds).select("k1", "k2", "doc_id", "fp", F.xxhash64("fp", "least").alias("node"), pairs.alias("pairs")))
    nodes = written(made.groupBy("node").agg(F.first("fp").alias("fp"), F.first("pairs").alias("pairs")))
    roots = _grouped(nodes.select("fp", "node", F.posexplode("pairs").alias("t", "key")), radius)
    rooted = made.select("k1", "k2", "doc_id", "node").join(roots, "node", "left")
    return rooted.select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = COPY_SHINGLE, radius: int = COPY_RADIUS) -> DataFrame:
    """The rows of ``docs`` with the least id of each group of near copies; of rows that repeat, one."""
    groups = copy_groups(docs, doc_id=doc_id, text=text, shingle=shingle, radius=radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("x")
    kept = groups.groupBy("group").agg(first).select("x.k1", "x.k2")
    k1, k2 = row_key(doc_id, text)
    keyed = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    # rows that repeat: the first of each task before the shuffle, then of all
    once = keyed.withColumn("i", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).filter("i = 1")
    return once.join(kept, ["k1", "k2"], "left_semi").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
