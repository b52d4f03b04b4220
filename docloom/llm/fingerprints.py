r"""Document fingerprints by consistent weighted sampling (operator 1), in DataFrame functions only.

A document is its words with their counts.  For each of ``SAMPLES`` samples and
each word, gamma variables r, c and a uniform b, all functions of the word and
the sample's number, give

    t = floor(ln(w) / r + b),   ln a = ln c - r (t - b) - r,

and the sample is the least ln a.  Two documents have the same sample with a
probability equal to their generalised Jaccard similarity, sum of minima over
sum of maxima of the counts.  A fingerprint is 16 bits of hash of each sample.

How it runs:

* Documents are dealt out once, into ranges of ids whose bounds are quantiles of
  the ids, a task each, and each range also gets the rows of the next one's first
  id.  So the next document of every document is in its own task, without a global
  order.
* All groupings after that are by (range, row, ...), which the one exchange
  already serves.
* A word can only have the least ln a if c e^-r / w, a lower bound, is small.
  Words over ``REACH`` / (sum of w) are skipped before any logarithm; a sample
  fails to find its least value with probability e^-REACH.

Null texts are empty; a text without words has a fingerprint of its own, likeness
1 to its like and 0 to others.  Ids are numbers; a null id comes before all
others.  Rows of equal id are ordered by a hash of their text.  Repeated rows give
repeated results; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docloom.llm.common import row_key, table

SAMPLES = 64
#: Samples worked out in one pass over the words; their code stays small enough to be compiled.
GROUP = 8
REACH = 24.0
#: Exchange partitions, and id ranges, for each shuffle partition of the session.
FINER = 4

_SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def term_arrays(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE, -1), lambda w: w != "")


def _unit(bits: Column, width: int) -> Column:
    """Uniform in (0, 1] from ``width`` bits."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)) + 1) / float(1 << width)


def _sample(number: Column) -> Column:
    """ln a of the word with hash ``h`` and count ``w`` among ``n``; null if it is out of reach."""
    x, y = F.xxhash64("h", number * 2), F.xxhash64("h", number * 2 + 1)
    e_r = _unit(x, 32) * _unit(F.shiftrightunsigned(x, 32), 32)
    e_c = _unit(y, 20) * _unit(F.shiftrightunsigned(y, 20), 20)
    b = _unit(F.shiftrightunsigned(y, 40), 24)
    w = F.col("w")
    r = -F.ln(e_r)
    t = F.floor(F.ln(w) / r + b)
    # e_r and e_c of 1 make a gamma variable of 0, which has probability 0
    return F.when((e_r < 1) & (e_c < 1) & ((1 - e_c) * e_r * F.col("n") <= REACH * w), F.ln(-F.ln(e_c)) - r * (t - b + 1))


def signatures(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample codes) of rows (keys, h, w, n): words' hashes, counts and the document's number of words."""
    groups = terms.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // GROUP - 1))))
    least = groups.groupBy(*keys, "g").agg(*(F.min(_sample(F.col("g") * GROUP + j)).alias(f"s{j}") for j in range(GROUP)))
    code = lambda j: F.coalesce(F.xxhash64(f"s{j}").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(-1))
    least = least.select(*keys, "g", F.array(*(F.when(F.col(f"s{j}").isNotNull(), code(j)).otherwise(-1) for j in range(GROUP))).alias("codes"))
    return least.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("g", "codes"))), lambda x: x["codes"])).alias("codes"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guard, row, doc_id, text, next): every row with the next row's text; guards repeat the next range's first rows."""
    spark = docs.sparkSession
    parts = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("doc_id", [i / parts for i in range(parts)], max(10_000, 10 * parts))
    bounds, low, lacking = docs.agg(quantiles, F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = sorted({low, *(bounds or [])} - {None}) or [0]
    kind = docs.schema["doc_id"].dataType
    # two levels, so that an id is compared with some dozens of the bounds; one literal each
    width = math.isqrt(len(bounds) - 1) + 1
    levels = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.from_json(F.lit(json.dumps([x[0] for x in levels], default=str)), ArrayType(kind))
    groups = F.from_json(F.lit(json.dumps(levels, default=str)), ArrayType(ArrayType(kind)))
    up_to = lambda x: F.size(F.filter(x, lambda b: b <= F.col("doc_id")))
    level = F.greatest(up_to(heads), F.lit(1))
    held = F.element_at(groups, level)
    # the ranges: below and from the first bound, from the second, and so on
    bucket = F.coalesce(F.greatest((level - 1) * width + up_to(held) - 1, F.lit(0)), F.lit(0))
    first = F.col("doc_id").isNull() if lacking else F.col("doc_id") == F.lit(bounds[0]).cast(kind)
    opens = F.array_contains(held, F.col("doc_id")) & (F.col("doc_id") != F.lit(bounds[0]).cast(kind))
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guard"))
    before = F.struct(F.when(first, F.lit(len(bounds) - 1)).otherwise(bucket - 1).cast("int").alias("bucket"), F.lit(True).alias("guard"))
    both = F.when(F.coalesce(first | opens, F.lit(False)), F.array(own, before)).otherwise(F.array(own))
    k1, k2 = row_key("doc_id", "text")
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"), F.explode(both).alias("x")).select("x.*", "doc_id", "text", "k1", "k2").repartitionById(parts, F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy("guard", "doc_id", "k1", "k2")
    return dealt.select("bucket", "guard", F.row_number().over(order).alias("row"), "doc_id", "text", F.lead("text").over(order).alias("next"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.coalesce("next", F.lit("")), F.lit(1), k)))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"))))
    words = rows.select("bucket", "row", sides.alias("x")).select("bucket", "row", "x.side", term_arrays(F.col("x.t")).alias("words"))
    words = words.select("bucket", "row", "side", F.size("words").alias("n"), F.explode("words").alias("word"))
    terms = words.select("bucket", "row", "side", "n", F.xxhash64("word").alias("h")).groupBy("bucket", "row", "side", "n", "h").agg(F.count("*").alias("w"))
    made = signatures(terms, ["bucket", "row", "side"])
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("codes")))
    pairs = made.groupBy("bucket", "row").agg(side(0).alias("a"), side(1).alias("e"))
    base = rows.select("bucket", "row", "guard", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    order = Window.partitionBy("bucket").orderBy("row")
    both = base.join(pairs, ["bucket", "row"], "left").withColumn("z", F.lead(F.struct("a")).over(order)).filter("NOT guard")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _text("a").alias("fingerprint"),
        _text("e").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"),
        likeness(F.col("a"), F.col("z.a")).alias("near_next"),
    )


def _text(codes: str) -> Column:
    """Four hex digits a sample; dots where there is none."""
    one = F.transform(codes, lambda c: F.when(c < 0, "....").otherwise(F.lower(F.lpad(F.hex(c), 4, "0"))))
    return F.coalesce(F.array_join(one, ""), F.lit("." * 4 * SAMPLES))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; documents without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda x: x)) / float(SAMPLES)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
