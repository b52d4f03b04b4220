"""Token counts without token ids (operator 4).

Pieces are counted once for each distinct pre-token; each document's pre-token
frequencies are joined to these counts and summed.

* Each distinct pre-token is encoded to its length alone; no id leaves the call.
* The lengths of the most frequent pre-tokens, ``bound`` of them at most, are
  broadcast; a document's share of these is summed where the document is read.
* Only its rarer pre-tokens, once each with their frequency, are shuffled to
  their lengths.  The sums travel with them under keys of their own, so that no
  key has more rows than a rare pre-token has documents.
* Null and empty texts have 0 bytes and 0 tokens.  A null id stays null.
  Repeated rows give repeated results.  An empty table gives an empty result.
  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from docloom.llm.common import small_batches, table, with_fields
from docloom.llm.vocabulary import BROADCAST_PIECES, Encoder, Splitter, by_frequency, piece_counts, token_lengths

def count_tokens(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", bound: int = BROADCAST_PIECES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the byte-level BPE tokenizer at ``tokenizer_path`` counts them."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    split = Splitter(tokenizer_path, "byte")
    lengths = token_lengths(piece_counts(docs, "text", split), Encoder(tokenizer_path))
    known, rare = by_frequency(lengths, bound, "k")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.value
        for b in batches:
            sums, pieces, times, ends = [], [], [], [0]
            for x in b.column(1).to_pylist():
                total = 0
                for piece, n in Counter(split(x)).items():
                    if piece in k:
                        total += n * k[piece]
                    else:
                        pieces.append(piece)
                        times.append(n)
                sums.append(total)
                ends.append(len(pieces))
            offsets = pa.array(ends, pa.int32())
            others = pa.ListArray.from_arrays(offsets, pa.array(pieces, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sums, pa.int64()), *others], ["doc_id", "n_bytes", "known", "p", "f"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kinds = with_fields(sized.select("doc_id", "n_bytes").schema, known=LongType(), p=ArrayType(StringType()), f=ArrayType(LongType()))
    # a number that is this row's own, so that repeated rows stay apart
    per_doc = sized.mapInArrow(summed, kinds).withColumn("row", F.monotonically_increasing_id())
    own = F.array(F.struct(F.lit("").alias("p"), F.col("known").alias("f"), (F.col("row") + 1).alias("own")))
    others = F.transform(F.arrays_zip("p", "f"), lambda x: F.struct(x["p"].alias("p"), x["f"].alias("f"), F.lit(0).cast("long").alias("own")))
    rows = per_doc.select("row", "doc_id", "n_bytes", F.explode(F.concat(own, others)).alias("x")).select(
        "row", F.when(F.col("x.own") > 0, F.struct("doc_id", "n_bytes")).alias("doc"), F.col("x.p").alias("piece"), F.col("x.own").alias("own"), F.col("x.f").alias("f")
    )
    lengths_of = rare.select("piece", F.lit(0).cast("long").alias("own"), "k")
    return (
        rows.join(lengths_of, ["piece", "own"], "left")
        .groupBy("row")
        .agg(F.max("doc").alias("doc"), F.sum(F.col("f") * F.coalesce("k", F.lit(1))).alias("n_tokens"))
        .select("doc.doc_id", "doc.n_bytes", "n_tokens")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
