"""Language identification by compression (operator 6).

For every language a raw-content zstandard dictionary is made of sample texts.
The whole text, lower-cased, with all that is neither letter nor mark as single
spaces, is compressed with each dictionary in pieces of ``PIECE`` characters; the
smallest total names the language.  Where the runner-up
is less than ``NARROW`` longer, the answer is rejected.

Training takes a bounded sample: the ``LANGUAGES`` most frequent languages, about
``SAMPLE_ROWS`` texts of each, chosen by the hash of the id, and of each text an
equal share of ``DICTIONARY_BYTES``, in stretches of words spread evenly over it.
Only the text is an input of a prediction, and all of it is used.

``lang_pred`` is ``und`` (score 0) for null texts, texts without a letter (of
Unicode category L), and where no language could be learned.  Where two languages
take equally few bytes, the first by name is given, with score 0.  A null id is
held out as crc32 over '' says.  Repeated rows give repeated results; an empty
table an empty one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from docloom.llm.common import crc_mod, small_batches, table, with_fields
from docloom.llm.compression import CARRIER, TAIL, compressor

LANGUAGES, SAMPLE_ROWS = 200, 200
DICTIONARY_BYTES = 48_000
PIECE = 512
#: Share by which the runner-up must be longer.
NARROW = 0.02
LEVEL = 6

_BETWEEN = regex.compile(r"[^\p{L}\p{M}]+").sub


def folded(text: str) -> str:
    return " " + _BETWEEN(" ", text.lower()).strip() + " "


def stretches(text: str, most: int, stretch: int = 12) -> bytes:
    """About ``most`` bytes of a text's words, in stretches spread evenly over it."""
    ws = folded(text).split()
    size = len(" ".join(ws).encode())
    if size <= most:
        return " ".join(ws).encode()
    n = -(-len(ws) // stretch)
    held = max(1, min(n, n * most // size))
    return " ".join(w for k in range(held) for w in ws[k * n // held * stretch : (k * n // held + 1) * stretch]).encode()


def dictionaries(rows: list[tuple[str, bytes]]) -> dict[str, bytes]:
    """Raw content for each language from (language, sample) rows."""
    by: dict[str, list[bytes]] = {}
    for lang, sample in rows:
        by.setdefault(lang, []).append(sample)
    return {lang: b" ".join(by[lang]) + CARRIER + TAIL for lang in sorted(by) if b"".join(by[lang]).strip()}


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Learn from rows outside of the held-out fold (crc32 of the id mod 5 = 0)."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("l IS NOT NULL AND t IS NOT NULL").filter(crc_mod(F.col("id"), 5) != 0)
    shares = known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    if not shares:
        return {}
    # hashes are uniform, so a bound on them takes about `rows` rows of a language
    bounds = F.create_map(*(F.lit(x) for r in shares for x in (r["l"], int(min(1.0, 1.5 * rows / r["count"]) * (1 << 31)))))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 31)) <= F.try_element_at(bounds, "l")).select("l", "t", F.xxhash64("id", F.lit(6)).alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples = [stretches(x, DICTIONARY_BYTES // rows) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(samples, pa.binary()), b.column(2)], ["l", "s", "h"])

    found = chosen.mapInArrow(cut, "l string, s binary, h long").toArrow().to_pylist()
    found.sort(key=lambda r: (r["h"], r["s"]))
    kept: dict[str, list[tuple[str, bytes]]] = {}
    for r in found:
        own = kept.setdefault(r["l"], [])
        if len(own) < rows:
            own.append((r["l"], r["s"]))
    return dictionaries([x for own in kept.values() for x in own])


class Coders:
    """A compressor for each language, with what the frame takes under it; made once in a task."""

    def __init__(self, by_lang: dict[str, bytes]):
        frame = CARRIER + TAIL
        self.all = [(lang, c := compressor.__wrapped__(d, LEVEL).compress, len(c(frame))) for lang, d in by_lang.items()]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.all or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        whole = folded(text)
        pieces = [b"".join((CARRIER, whole[i : i + PIECE].encode(), TAIL)) for i in range(0, len(whole), PIECE)]
        sizes = sorted((sum(len(compress(x)) - frame for x in pieces), lang) for lang, compress, frame in self.all)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = sizes[1][0] / max(1, sizes[0][0]) - 1
        return sizes[0][1], margin / (margin + NARROW) if margin else 0.0, margin < NARROW


def identify(docs: DataFrame, by_lang: dict[str, bytes], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected); ``lang_pred`` is the best language even where it is rejected."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(sent.value)
        for b in batches:
            found = [coders.classify(x) for x in b.column(1).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, with_fields(docs.select("doc_id").schema, lang_pred=StringType(), score=DoubleType(), rejected=BooleanType()))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
