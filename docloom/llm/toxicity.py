"""Toxicity by compression distance (operator 5).

Two zstandard dictionaries are made, one of ordinary and one of toxic text.  The
ordinary one is trained by zstandard on windows of ordinary rows.  The toxic one
is raw content: the words that set toxic rows apart, by the log-likelihood ratio
of their document counts, each a window of toxic text.  (Trained by zstandard on
whole toxic texts, most of it is what toxic and ordinary texts have in common;
the README has figures.)  A window is a word with its boundaries.  Its distance
is the part of its length under the ordinary dictionary that the toxic one
saves; a window over a calibrated threshold is a hit, and a logistic curve over
hits, calibrated on rows whose words took no part in the training (two folds),
gives the score.

Training takes a bounded sample: ``TRAIN_ROWS`` labelled rows at most, chosen by
the hash of the id; of each at most ``TRAIN_WORDS`` words, in stretches spread
evenly over its text; of ordinary rows at most ``TRAIN_WINDOWS`` windows.  Only
texts are inputs of a score.  All words of whole texts are scored; a task
compresses a word once.

Null, empty and wordless texts have no hits and so the score of such texts.
Without labelled rows, or with labels of one kind, every score is their share of
toxic rows (0 without any).  An id with labels of both kinds counts as toxic.
Null ids are in fold 0 of crc32 over ''.  Repeated rows give repeated results and
count once in training if their texts are equal; an empty table gives an empty
one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docloom.llm.common import crc_mod, free_name, small_batches, table, with_fields
from docloom.llm.compression import CARRIER, TAIL, compressor, trained

TRAIN_ROWS, TRAIN_WORDS, TRAIN_WINDOWS = 6_000, 4_000, 20_000
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 16_384
#: Twice the log-likelihood ratio that a word of the toxic dictionary needs.
APART = 20.0
THRESHOLDS = (0.4, 0.5, 0.6, 0.7)
#: Words whose distance a task keeps at hand.
AT_HAND = 150_000
REJECT = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: float = 0.6
    weights: tuple[float, ...] = ()
    prior: float = 0.0
    at_hand: dict[str, float] = field(default_factory=dict)
    #: compressors of both dictionaries, and what a window's frame takes under each
    coders: tuple = ()

    def __getstate__(self):
        return self.__dict__ | {"at_hand": {}, "coders": ()}

    def distance(self, word: str) -> float:
        """The share of a word's length that the toxic dictionary saves."""
        d = self.at_hand.get(word)
        if d is None:
            if not self.coders:
                frame = CARRIER + TAIL
                both = [compressor(x + frame).compress for x in (self.ordinary, self.ordinary + self.toxic)]
                self.coders = (*both, *(len(x(frame)) for x in both))
            plain, toxic, plain_frame, toxic_frame = self.coders
            x = b"".join((CARRIER, b" ", word.encode(), b" ", TAIL))
            a, b = len(plain(x)) - plain_frame, len(toxic(x)) - toxic_frame
            d = (a - b) / max(1, a)
            if len(self.at_hand) >= AT_HAND:
                self.at_hand.clear()
            self.at_hand[word] = d
        return d

    def features(self, text: str | None) -> tuple[int, int]:
        """Windows over the threshold, and windows."""
        ws = words(text)
        return self.hits(ws, (self.threshold,))[0], len(ws)

    def hits(self, ws: list[str], thresholds: tuple[float, ...]) -> list[int]:
        """Windows over each threshold."""
        out = [0] * len(thresholds)
        if self.toxic:
            for w, n in Counter(ws).items():
                d = self.distance(w)
                for i, at in enumerate(thresholds):
                    out[i] += n * (d >= at)
        return out

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        z = float(np.dot(self.weights, _inputs(*self.features(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _inputs(hits: int, n: int) -> tuple[float, ...]:
    return 1.0, float(min(hits, 3)), math.log1p(200 * hits / max(n, 1))


def _dictionaries(rows: list[tuple[list[str], int]]) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary of rows of words, each different text once."""
    rows = list({tuple(ws): (ws, y) for ws, y in rows}.values())
    counts = Counter(), Counter()
    for ws, y in rows:
        counts[y].update(set(ws))
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    if not all(n):
        return b"", b""
    share = n[1] / (n[0] + n[1])

    def apart(a: int, b: int) -> float:
        return 2 * sum(x * math.log(x / e) for x, e in ((a, (a + b) * share), (b, (a + b) * (1 - share))) if x)

    found = sorted(((apart(k, counts[0][w]), w) for w, k in counts[1].items() if k * n[0] > counts[0][w] * n[1]), reverse=True)
    toxic = b""
    for g, w in found:
        if g < APART or len(toxic) > TOXIC_BYTES:
            break
        toxic += b" " + w.encode()
    ordinary = trained(list(islice(((" " + " ".join(ws[i : i + 40]) + " ").encode() for ws, y in rows if not y for i in range(0, len(ws), 40)), TRAIN_WINDOWS)), ORDINARY_BYTES)
    return ordinary, toxic + b" " if toxic else b""


def thinned(ws: list[str], most: int = TRAIN_WORDS, stretch: int = 40) -> list[str]:
    """At most ``most`` words, in stretches spread evenly over all."""
    if len(ws) <= most:
        return ws
    n, held = -(-len(ws) // stretch), most // stretch
    return [w for k in range(held) for w in ws[k * n // held * stretch : (k * n // held + 1) * stretch]]


def train(rows: list[tuple[list[str], int]]) -> Model:
    """Fit on (words, label) rows."""
    names: dict[str, str] = {}  # each different word once in memory
    cut = [([names.setdefault(w, w) for w in ws], int(y)) for ws, y in rows]
    names.clear()
    prior = sum(y for _, y in cut) / len(cut) if cut else 0.0
    model = Model(prior=prior)
    if not 0 < prior < 1:
        return model
    model.ordinary, model.toxic = _dictionaries(cut)
    if not model.toxic:
        return model
    seen: list[tuple[list[int], int, int]] = []  # hits at each threshold, windows, label
    for k in (0, 1):
        half = Model()
        half.ordinary, half.toxic = _dictionaries(cut[1 - k :: 2])
        seen += [(half.hits(ws, THRESHOLDS), len(ws), y) for ws, y in cut[k::2]]
    y = np.array([x[2] for x in seen], float)
    fits = [(*_logistic(np.array([_inputs(h[i], n) for h, n, _ in seen]), y), at) for i, at in enumerate(THRESHOLDS)]
    model.weights, _, model.threshold = min(fits, key=lambda f: f[1])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[tuple[float, ...], float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return tuple(map(float, w)), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Train on labelled rows outside of the held-out fold (crc32 of the id mod 4 = 2)."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(crc_mod(F.col("id"), 4) != 2)
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id", F.lit(5))).orderBy("h", "id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    # at most `rows` ids, so that the texts are looked up without a shuffle; rows of an id that repeat count once
    sample = texts.join(F.broadcast(chosen), "id").groupBy("h", "id", F.sha2("t", 256).alias("s")).agg(F.first("t").alias("t"), F.first("y").alias("y"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [" ".join(thinned(words(x))) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ws, pa.string()), b.column(3)], ["h", "s", "t", "y"])

    # one task can train on these few
    sample = sample.select("h", "s", "t", "y").mapInArrow(cut, "h long, s string, t string, y int").orderBy("h", "s").limit(rows).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(r["h"], r["s"] or "", r["t"].split(), r["y"]) for b in batches for r in b.to_pylist()]
        found.sort()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(ws, y) for _, _, ws, y in found]))], pa.binary())], ["model"])

    made = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else train([])


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every row's whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            at = b.schema.get_field_index(text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(x) for x in b.column(at).to_pylist()], pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, with_fields(docs.schema, **{out: DoubleType()}))


def reject(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = REJECT) -> DataFrame:
    """The rows of ``docs`` with a score under the threshold, with their columns."""
    out = free_name(docs, "_score")
    return score(docs, model, text=text, out=out).filter(F.col(out) < threshold).drop(out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
