"""BPE encoding and decoding through a distinct-word table (operator 7).

Words are split in Spark tasks, each distinct word of the corpus is encoded
once, and ids are joined back by position:

* the most frequent words (``bound`` of them at most, compared as they are) are
  broadcast, and a document is put down as the numbers of its words by position, by
  frequency and so in a byte or two each; its other words have numbers of its own;
* these others, once for each document, are shuffled to their ids, and the ids to
  the document, where numbers are replaced by ids.

``decode`` joins ids to pieces through the id-to-piece table, whose size is the
tokenizer's vocabulary, so that each task has the whole of it.

Null and empty texts have no ids and decode to ''.  Null ids stay null, repeated
rows give repeated results, an empty table an empty one; other columns are not
read.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from docloom.llm.common import small_batches, table, with_fields
from docloom.llm.vocabulary import BROADCAST_PIECES, Encoder, Splitter, by_frequency, encoded, piece_counts, tokenizer

#: No word's number: one that the broadcast table lacks.
HOLE = 0xFFFFFFFF


def encode(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", bound: int = BROADCAST_PIECES, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every row's whole text; with ``decoded`` also what ``decode`` makes of them, in the same pass."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    split = Splitter(tokenizer_path, "word")
    kind = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    words = encoded(piece_counts(docs, "text", split), Encoder(tokenizer_path), kind)
    known, rare = by_frequency(words, bound, "ids")
    pieces = piece_table(spark, tokenizer_path) if decoded else None

    def put_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(known.value)}
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            held = []
            for x in b.column(1).to_pylist():
                ws = split(x)
                at = np.array([number.get(w, HOLE) for w in ws], "<u4")
                own: dict[str, int] = {}
                for i in np.flatnonzero(at == HOLE).tolist():
                    at[i] = len(number) + own.setdefault(ws[i], len(own))
                planes = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T)
                held.append(pack(marshal.dumps((planes.tobytes(), list(own)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], ["doc_id", "held"])

    def holes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows, names, at = [], [], []
            for row, x in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, own = marshal.loads(unpack(x))
                rows += [row] * len(own)
                names += own
                at += range(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.string()), pa.array(at, pa.int32())], ["row", "piece", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = list(known.value.values())
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            flat = b.column(2).flatten()
            at, own = flat.field(0).to_pylist(), flat.field(1).to_pylist()
            ends = np.cumsum([0, *(len(x) if x.is_valid else 0 for x in b.column(2))])
            ids = []
            for i, x in enumerate(b.column(1).to_pylist()):
                planes = np.frombuffer(marshal.loads(unpack(x))[0], np.uint8)
                numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().tolist()
                rare_ids = dict(zip(at[ends[i] : ends[i + 1]], own[ends[i] : ends[i + 1]], strict=True))
                n = len(ids_of)
                ids.append(b"".join([ids_of[k] if k < n else rare_ids[k - n] for k in numbers]))
            columns, names = [b.column(0), _lists(ids, kind)], ["doc_id", "ids"]
            if pieces is not None:
                columns.append(pa.array([_joined(np.frombuffer(x, kind), pieces) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    ids_kind = ArrayType(IntegerType())
    put = with_fields(docs.select("doc_id").schema, held=BinaryType())
    # a number that is this row's own, so that repeated rows stay apart; both uses of this shuffle read all of its columns, so they share its files
    rows = docs.mapInArrow(put_down, put).withColumn("row", F.monotonically_increasing_id()).repartition("row")
    holes = rows.mapInArrow(holes_of, "row long, piece string, at int")
    found = holes.join(rare.select("piece", F.col("ids").alias("own")), "piece").groupBy("row").agg(F.collect_list(F.struct("at", "own")).alias("found"))
    whole = rows.join(found, "row", "left").select("doc_id", "held", "found")
    return whole.mapInArrow(fill, with_fields(docs.select("doc_id").schema, ids=ids_kind, **({"decoded": StringType()} if decoded else {})))


def _lists(ids: list[bytes], kind: str) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) // np.dtype(kind).itemsize
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), kind).astype(np.int32)))


def piece_table(spark: SparkSession, tokenizer_path: str) -> Broadcast:
    """The piece of every id; as long as the tokenizer's vocabulary."""
    t = tokenizer(tokenizer_path)
    return spark.sparkContext.broadcast([t.id_to_token(i) for i in range(t.get_vocab_size())])


def _joined(ids: np.ndarray, pieces: Broadcast) -> str:
    return " ".join(map(pieces.value.__getitem__, ids.tolist()))


def decode(encoded_docs: DataFrame, tokenizer_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for: their pieces, joined as the tokenizer's decode does without a decoder, by spaces."""
    small_batches(encoded_docs.sparkSession)
    pieces = piece_table(encoded_docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(ids)
            texts = [_joined(x.values.to_numpy(), pieces) if x.is_valid else None for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return encoded_docs.mapInArrow(run, with_fields(encoded_docs.schema, **{out: StringType()}))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    return encode(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
