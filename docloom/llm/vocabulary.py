"""Distinct-piece tables: each distinct pre-token is encoded once, then joined.

A corpus has far fewer distinct pre-tokens than pre-tokens, but their number
still grows with the corpus.  The table is therefore split: the most frequent
pieces, at most ``bound`` of them, are small enough to broadcast and cover
nearly all occurrences; all others are joined by a shuffle.  Both ways are exact.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, written

#: Distinct pieces that a task counts before it sends the counts on.
FLUSH = 200_000
#: Pieces in a broadcast table, and bytes of each at most: some 40 MB in a Python worker.
BROADCAST_PIECES, BROADCAST_BYTES = 300_000, 64

#: The pre-token patterns of the public tokenizer files, in the syntax of ``regex``; white space is that of Unicode.
EXACT = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+",
}
#: The same for texts of ASCII and of Latin letters alone, in the syntax of ``re``, which is about twice as fast.
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
ASCII = {
    "byte": rf" ?[A-Za-z]+| ?[0-9]+|{_SHORT}| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+",
    "word": rf"[A-Za-z]+|[0-9]|{_SHORT}|[^A-Za-z0-9 \t-\r]+",
}
_BLANK = r" \t-\r\x85\xa0"
LATIN = {
    "byte": rf" ?[^\W\d_]+| ?[0-9]+|{_SHORT}| ?(?:[^\w{_BLANK}]|_)+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+",
    "word": rf"[^\W\d_]+|[0-9]|{_SHORT}|(?:[^\w{_BLANK}]|_)+",
}
#: What a text of the last kind does not have: other scripts, and numbers that are no digits.
BEYOND_LATIN = "[^\\x00-\\u024f]|[²³¹¼½¾]"


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """Cut a text into pre-tokens and special tokens as the tokenizer at ``path`` does; kind: "byte" or "word" (which lowers)."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self._ready = False

    def __getstate__(self):
        return {"path": self.path, "kind": self.kind, "_ready": False}

    def _prepare(self) -> None:
        import regex

        t = tokenizer(self.path)
        self.special = {x.content for x in t.get_added_tokens_decoder().values()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.exact = regex.compile(EXACT[self.kind]).findall
        self.ascii, self.latin = re.compile(ASCII[self.kind]).findall, re.compile(LATIN[self.kind]).findall
        self.beyond = re.compile(BEYOND_LATIN).search
        self.normal = t.normalizer.normalize_str if t.normalizer is not None else None
        self.pre = t.pre_tokenizer.pre_tokenize_str
        self.known: set[str] = set()
        self._ready = True

    def _newer(self, text: str) -> bool:
        """Whether the text has characters that this Python's Unicode tables lack; such texts are cut by the tokenizer itself."""
        for c in set(text) - self.known:
            if unicodedata.category(c) == "Cn":
                return True
            self.known.add(c)
        return False

    def _cut(self, text: str) -> list[str]:
        lower = self.kind == "word"
        if text.isascii():
            # here the normaliser only lowers, and white space is no part of a word
            return self.ascii(text.lower() if lower else text)
        known = not self._newer(text)
        if self.normal is not None:
            # composed, then lowered letter by letter: a final sigma is like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if known and lower else self.normal(text)
        if not known:
            return [text[a:b] for _, (a, b) in self.pre(text)]
        return self.exact(text) if self.beyond(text) else self.latin(text)

    def __call__(self, text: str | None) -> list[str]:
        if not self._ready:
            self._prepare()
        if not text:
            return []
        if self.at_special is None or not any(x in text for x in self.special):
            return self._cut(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._cut(part)
        return out


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of one pre-token or special token, from the tokenizer's merge table alone."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, piece: str) -> list[int]:
        t, letters = tokenizer(self.path), byte_letters()
        if piece.startswith("<|") and (special := {x.content: k for k, x in t.get_added_tokens_decoder().items()}.get(piece)) is not None:
            return [special]
        return [x.id for x in t.model.tokenize("".join(map(letters.__getitem__, piece.encode())))]


def piece_counts(docs: DataFrame, text: str, split: Callable[[str | None], list[str]]) -> DataFrame:
    """(piece, n): occurrences over all documents, combined in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["piece", "n"])

        c: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                c.update(split(x.as_py()))
                if len(c) >= FLUSH:
                    yield out()
                    c = Counter()
        yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def token_lengths(counts: DataFrame, encode: Callable[[str], list[int]]) -> DataFrame:
    """(piece, n, k): the number of tokens of each distinct piece; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = pa.array([len(encode(x)) for x in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), k], ["piece", "n", "k"])

    return written(counts.mapInArrow(run, "piece string, n long, k int"))


def encoded(counts: DataFrame, encode: Callable[[str], list[int]], kind: str) -> DataFrame:
    """(piece, n, ids): each distinct piece encoded once, ids as numbers of ``kind``; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([np.array(encode(x), kind).tobytes() for x in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], ["piece", "n", "ids"])

    return written(counts.mapInArrow(run, "piece string, n long, ids binary"))


def frequency_floor(counts: DataFrame, bound: int) -> int:
    """The least power of two such that at most ``bound`` pieces are that frequent.

    Only a histogram by power of two, some tens of rows, comes to the driver.
    """
    steps = sorted(((r.p, r.k) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, floor = 0, 62
    for p, k in steps:
        if held + k > bound:
            break
        held, floor = held + k, p
    return 1 << floor


def by_frequency(pieces: DataFrame, bound: int, value: str) -> tuple[Broadcast, DataFrame]:
    """Split a piece table: a broadcast dict of its most frequent pieces, the most frequent first, and the rows of all others.

    The dict has ``bound`` pieces of ``BROADCAST_BYTES`` at most.
    """
    short = F.octet_length("piece") <= BROADCAST_BYTES
    floor = frequency_floor(pieces.filter(short), bound)
    held = short & (F.col("n") >= floor)
    found = pieces.filter(held).select("piece", value, "n").toArrow().sort_by([("n", "descending"), ("piece", "ascending")])
    known = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    return pieces.sparkSession.sparkContext.broadcast(known), pieces.filter(~held)
