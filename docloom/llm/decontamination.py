r"""Benchmark decontamination by a prefix-filtered set join (operator 9).

A window is ten consecutive words of a benchmark item (all of a shorter item).
Each window is a set of shingles of up to three words with positions.  To be
contained in a document, all its shingles must be, so a necessary prefix of one
shingle suffices: the one found in the fewest documents.  A document position
with that shingle fixes where the window would have to start (positional bound)
and end (length bound); the window is then verified word by word.

* Document counts of the benchmark's shingles come from all documents, combined
  in each task; only the benchmark's own shingles are counted and collected.
* The distinct windows are a table of their own.  It is counted, and broadcast in
  blocks of at most ``block_windows`` windows and about ``BLOCK_BYTES`` bytes
  (windows are dealt by hash, so an item of any length is split); one block for
  benchmarks of ordinary size.  Each block meets all documents, and what the
  blocks found is put together by document.
* Null texts have no words.  Items with a null id or no words are not looked
  for.  Null document ids stay null; repeated rows give repeated results; items
  that repeat count once; with an empty benchmark nothing is hit.  Other columns
  are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

from docloom.llm.common import row_key, small_batches, table, with_fields, written

WINDOW = 10
SHINGLE = 3
#: Windows in one broadcast block, about 200 MB in a Python worker.
BLOCK_WINDOWS = 200_000
#: Bytes of the words of a block's windows.
BLOCK_BYTES = 32 << 20

#: ASCII bytes that are no part of a word become spaces, A-Z become a-z; all others are kept.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(ws: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not ws:
        return []
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]


def grams(ws: list[bytes], q: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(ws[i:] for i in range(q)), strict=False)


class Block:
    """Some benchmark windows with their items, and, once rarity is known, their prefix shingles."""

    def __init__(self, windows: list[tuple[bytes, list]]):
        self.windows: dict[tuple[bytes, ...], list] = {tuple(w.split(b" ")): items for w, items in windows}
        self.shingles = {g for w in self.windows for g in grams(list(w), min(SHINGLE, len(w)))}
        self.sizes = sorted({len(g) for g in self.shingles})

    def index(self, found_in: dict[tuple[bytes, ...], int]) -> dict[int, dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...]]]]]:
        """By size and prefix shingle: (offset in the window, window).  Windows with a shingle that no document has are left out."""
        index: dict = {q: defaultdict(list) for q in self.sizes}
        for w in self.windows:
            q = min(SHINGLE, len(w))
            rarest = min((found_in.get(g, 0), g, at) for at, g in enumerate(grams(list(w), q)))
            if rarest[0]:
                index[q][rarest[1]].append((rarest[2], w))
        return {q: dict(x) for q, x in index.items() if x}


def matches(ws: list[bytes], index: dict) -> list[tuple[int, int, tuple[bytes, ...]]]:
    """(start, end, window) of every occurrence of a window."""
    out = []
    for q, prefixes in index.items():
        for i, g in enumerate(grams(ws, q)):
            if g in prefixes:
                for offset, w in prefixes[g]:
                    start, end = i - offset, i - offset + len(w)
                    if start >= 0 and end <= len(ws) and tuple(ws[start:end]) == w:
                        out.append((start, end, w))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: its hit words as merged [start, end) spans, and the ids of the items hit."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).filter("item IS NOT NULL AND t IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):  # an item at a time, however long
                ws = [b" ".join(w) for w in windows_of(words(b.column(1)[row].as_py()), window)]
                for i in range(0, len(ws), 10_000):
                    some = ws[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), b.column(0).take(pa.array([row] * len(some), pa.int64()))], ["w", "item"])

    kind = items.schema["item"].dataType
    windows = items.mapInArrow(cut, StructType([StructField("w", BinaryType()), StructField("item", kind)]))
    windows = written(windows.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items")))
    size = windows.agg(F.count("*").alias("n"), F.sum(F.length("w") + 8 * F.size("items")).alias("bytes")).first()
    n = max(1, -(-size.n // block_windows), -(-(size.bytes or 0) // BLOCK_BYTES))
    keyed = docs.select(*(c.alias(k) for c, k in zip(row_key("doc_id", "text"), ("k1", "k2"), strict=True)), "doc_id", "text")
    found = [_find_block(keyed, windows if n == 1 else windows.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == i), kind) for i in range(n)]
    if n == 1:
        return found[0].drop("k1", "k2")
    one = reduce(DataFrame.unionByName, found).groupBy("k1", "k2", "doc_id", "n_words").agg(F.count("*").alias("rows"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"s": s, "e": e} for s, e in merge([(x["s"], x["e"]) for x in own])] for own in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, b.column(2).type), b.column(3), b.column(4)], ["doc_id", "n_words", "spans", "items", "rows"])

    merged = one.select("doc_id", "n_words", "spans", "items", "rows")
    merged = merged.mapInArrow(put_together, merged.schema)
    # rows that repeat were grouped as one; they are told apart again by their number
    return merged.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), (F.col("rows") / n).cast("int"))).alias("copy")).drop("copy")


def _find_block(keyed: DataFrame, windows: DataFrame, item_kind: DataType) -> DataFrame:
    sc = keyed.sparkSession.sparkContext
    block = Block([(r.w, r["items"]) for r in windows.collect()])
    order = sorted(block.shingles)
    sent = sc.broadcast((block.sizes, {g: i for i, g in enumerate(order)}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, known = sent.value
        c: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                ws = words(x)
                for q in sizes:
                    c.update({known[g] for g in grams(ws, q) if g in known})
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["g", "n"])

    counted = keyed.select("text").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect() if order else []
    index = sc.broadcast((block.index({order[r.g]: r.n for r in counted}), dict(block.windows)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, owners = index.value
        for b in batches:
            n, spans, hit = [], [], []
            for x in b.column(3).to_pylist():
                ws = words(x)
                at = matches(ws, prefixes)
                n.append(len(ws))
                spans.append([{"s": s, "e": e} for s, e in merge([(s, e) for s, e, _ in at])])
                hit.append(sorted({i for w in {w for _, _, w in at} for i in owners[w]}))
            span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(hit, pa.list_(to_arrow_type(item_kind)))], ["k1", "k2", "doc_id", "n_words", "spans", "items"])

    span_kind = ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())]))
    return keyed.mapInArrow(look, with_fields(keyed.select("k1", "k2", "doc_id").schema, n_words=LongType(), spans=span_kind, items=ArrayType(item_kind)))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    whole = docs.select(F.struct("*").alias("doc_id"), F.col(text).alias("text"))
    return find(whole, benchmark).filter(F.size("spans") == 0).select("doc_id.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def digests(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract, word by word; for tests."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut_up = [(i, word.findall((t or "").translate(fold))) for i, t in items if i is not None]
    out = []
    for d, t in docs:
        ws = word.findall((t or "").translate(fold))
        hit, ids = set(), set()
        for i, its in cut_up:
            for a in range(max(1, len(its) - window + 1) if its else 0):
                w = its[a : a + window]
                for p in range(len(ws) - len(w) + 1):
                    if ws[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        ids.add(str(i))
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


SQL = r"""
WITH fold AS (
  SELECT doc_id, row_number() OVER () AS rn,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), dw AS (
  SELECT rn, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM fold, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), hits AS (
  SELECT dw.rn, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s
), n AS (
  SELECT rn, count(DISTINCT q) AS n_hit FROM (SELECT rn, unnest(range(p, p + k)) AS q FROM hits) GROUP BY rn
), ids AS (
  SELECT rn, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN n USING (rn) LEFT JOIN ids USING (rn)
"""
