"""Connected components by contraction and pointer jumping.

A table of pointers (v, p), p < v, is contracted until every node points to the
least node of its component.  A round has two steps, each one shuffle or join
whose result is written to the shared checkpoint folder, so that a lost executor
costs one step at most:

* *hook*: each task contracts the rows it reads, some hundred thousand at a time,
  to stars by union-find; the stars meet by v, where they are contracted again.
  One row of each v is its pointer; rows that tie other nodes together are kept
  beside the pointers.
* *jump*: a pointer to a node that points on is replaced by that node's pointer.

A node with very many links gives one row for each task that reads some of them.
A node that very many point to is a skewed key of the join in *jump*, whose
other side has one row a key, so adaptive execution splits it.  Rounds grow with
the logarithm of the longest path.  Nothing is collected but two counts a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docloom.llm.common import discard, small_batches, written

#: Rows that a task contracts at once.
CHUNK = 500_000


def stars(v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes of the links, least nodes left out."""
    nodes, at = np.unique(np.concatenate([v, p]), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= CHUNK:
            yield tuple(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for v, p in _chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(v, p)], ["v", "p"])


def _hook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by v; the pointer of each v of the partition once, other rows marked as ties."""
    last = None
    for v, p in _chunks(batches):
        node, root = stars(v, p)
        pointer = np.isin(node, v)
        if last is not None:
            pointer &= node != last  # its pointer went out with the chunk before
        last = v[-1]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(~pointer)], ["v", "p", "tie"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long) that isn't its component's least node; root is that least node.

    Null ends and links of a node to itself are left out; repeated links don't matter.
    """
    small_batches(links.sparkSession)
    rows = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p"))
    before = None
    while True:
        star = rows.mapInArrow(_contract, "v long, p long")
        hooked = written(star.repartition("v").sortWithinPartitions("v").mapInArrow(_hook, "v long, p long, tie boolean"))
        if before is not None:
            discard(before)
        pointers, ties = hooked.filter("NOT tie").select("v", "p"), hooked.filter("tie").select("v", "p")
        onward = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
        seen = Observation()
        jumped = pointers.join(onward, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
        rows = jumped.unionByName(ties.withColumn("moved", F.lit(True)))
        rows = written(rows.observe(seen, F.count_if("moved").alias("n")).select("v", "p"))
        discard(hooked)
        if not seen.get["n"]:
            return rows.select(F.col("v").alias("node"), F.col("p").alias("root"))
        before = rows
