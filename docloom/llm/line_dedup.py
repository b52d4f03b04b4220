r"""Line dedup with per-document keep bitmaps (operator 10), in DataFrame functions only.

Lines are hashed to 128 bits, the hashes are range-partitioned and sorted by
(hash, document, position) with the largest document first, and one pass over
each partition finds the lines whose key is in enough documents and whose
document is not the first of its key.  What comes back for each document is a
bitmap of kept lines, compressed to run lengths, never text.

* Keys of more than one in ``HOT`` of all lines are found by ``approx_top_k``
  (so there are ``HOT`` of them at most).  Their lines never meet in one task:
  their document counts and largest documents are pre-aggregated in each task
  and broadcast back.  Either way is exact, so it does not matter which key
  takes which.
* Bitmaps are made and applied in time proportional to a document's lines.
* Each row is a document; rows of one id count as one document, and all rows of
  the largest id keep the line.  A null id counts as one document, smaller than
  any other.  Null and empty texts are one empty line.  Repeated rows give
  repeated results; an empty table an empty one.  Other columns are not read
  but ``apply_bitmaps`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import free_name, row_key, table, written

MIN_LENGTH = 20
MIN_DOCS = 3
#: Keys that may be treated as hot, and counters of the sketch that finds them.
HOT, TRACKED = 10_000, 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    # lower() folds more than A-Z, so it serves lines of ASCII alone
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, hot_share: int = HOT) -> DataFrame:
    """(k1, k2, runs): for each document with dropped lines, the run lengths kept, dropped, kept, dropped ... of its lines.

    Lines after the last run are kept.  (k1, k2) is ``row_key(doc_id, text)``.
    Keys of more than one in ``hot_share`` of the lines are pre-aggregated.
    """
    k1, k2 = row_key(doc_id, text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(F.col(doc_id)).alias("doc"), lines_of(text).alias("lines"))
    lines = rows.select("k1", "k2", "doc", F.posexplode("lines").alias("pos", "line"))
    # a line that is too short before stripping is too short after it
    keys = lines.filter(F.length("line") >= min_length).select("k1", "k2", "doc", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_length)
    # hashed once and written: what follows reads the hashes several times
    keys = written(keys.select("k1", "k2", "doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")))

    top = keys.agg(F.expr(f"approx_top_k(h1, {HOT}, {TRACKED})").alias("t"), F.count("*").alias("n")).select("n", F.explode("t").alias("x"))
    hot = F.broadcast(top.filter(F.col("x.count") > F.col("n") / hot_share).select(F.col("x.item").alias("h1")))

    first = F.max("doc").alias("first")  # of structs, so that a null id is less than any other
    hot_lines = keys.join(hot, "h1", "left_semi")
    hot_keys = hot_lines.groupBy("h1", "h2").agg(first, F.count_distinct("doc").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    hot_dropped = hot_lines.join(F.broadcast(hot_keys), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("first")))

    in_key = Window.partitionBy("h1", "h2").orderBy(F.desc("doc"))
    whole = in_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = keys.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "k1", "k2", "pos")
    cold_dropped = (
        ranged.withColumn("rank", F.dense_rank().over(in_key))
        .withColumn("n_docs", F.last("rank").over(whole))
        .filter((F.col("n_docs") >= min_docs) & (F.col("rank") > 1))
    )
    dropped = hot_dropped.select("k1", "k2", "pos").unionByName(cold_dropped.select("k1", "k2", "pos"))
    at = dropped.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return at.select("k1", "k2", _runs("at").alias("runs"))


def _runs(at: str) -> Column:
    """Sorted dropped positions to run lengths, kept lines first; no lambda looks outside of its element."""
    ahead = F.concat(F.array(F.lit(None).cast("int")), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
    after = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(None).cast("int")))
    edge = lambda other, step: F.transform(F.filter(F.arrays_zip(F.col(at).alias("x"), other.alias("y")), lambda z: z["y"].isNull() | (z["y"] + step != z["x"])), lambda z: z["x"])
    begins, ends = edge(ahead, 1), edge(after, -1)
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.size(ends) - 1))
    spans = F.arrays_zip(begins.alias("b"), ends.alias("e"), before.alias("p"))
    return F.flatten(F.transform(spans, lambda x: F.array(x["b"] - x["p"] - 1, x["e"] - x["b"] + 1)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text", kept: str = "_kept", dropped: str = "_dropped") -> DataFrame:
    """Add the text of the kept lines and the number of dropped ones to every row."""
    k1, k2 = row_key(doc_id, text)
    keyed = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    both = keyed.join(bitmaps.hint("shuffle_hash"), ["k1", "k2"], "left")
    whole = F.col("row").getField(text)
    flags = F.flatten(F.transform("runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    # lines after the last run have no flag
    marked = F.filter(F.arrays_zip(lines_of(whole).alias("line"), flags.alias("stays")), lambda x: F.coalesce(x["stays"], F.lit(True)))
    n_dropped = F.aggregate(F.filter("runs", lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda n, x: n + x)
    return both.select(
        "row.*",
        F.when(F.col("runs").isNull(), F.coalesce(whole, F.lit(""))).otherwise(F.array_join(F.transform(marked, lambda x: x["line"]), "\n")).alias(kept),
        F.coalesce(n_dropped, F.lit(0).cast("long")).alias(dropped),
    )


def thinned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their columns, texts without the dropped lines; a null text stays null."""
    kept, dropped = free_name(docs, "_kept"), free_name(docs, "_dropped")
    both = apply_bitmaps(docs, keep_bitmaps(docs, doc_id=doc_id, text=text), doc_id=doc_id, text=text, kept=kept, dropped=dropped)
    new = F.when(F.col(f"`{text}`").isNotNull(), F.col(kept))
    changed = {text: new} | ({n_chars: F.length(new).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return both.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame, *, hot_share: int = HOT) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs, hot_share=hot_share)).select(
        "doc_id",
        F.size(lines_of("text")).cast("long").alias("n_lines"),
        F.col("_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


SQL = r"""
WITH lines AS (
  SELECT rn, doc_id, p, l[p] AS line,
    translate(trim(l[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rn, doc_id, l, unnest(range(1, len(l) + 1)) AS p
        FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), keys AS (
  SELECT k, max(doc_id) AS first FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT rn, doc_id, p, line, keys.k IS NOT NULL AND doc_id <> first AS gone FROM lines LEFT JOIN keys ON lines.k = keys.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rn, doc_id
"""
