"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 32-bit hashes of words, word pairs and pairs around one skipped word, present or
not. One task learns from a bounded, seeded sample of labelled texts with per-coordinate rates;
L1 leaves few weights that are not zero. Those go to the driver and with the scoring function
to all tasks: at most ``MAX_WEIGHTS`` (hash, weight) pairs, 12 bytes each. A model with more is
learnt again with twice the L1 until it fits; no weight is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, trim

SAMPLE = 16_000  # most labelled texts that a model learns from (in expectation of the seeded draw)
MAX_WEIGHTS = 200_000
L1, EPOCHS = 8.0, 4
PUNCTUATION = b".,;:!?\"'()[]{}|*#"
WORD_CACHE = 150_000


class Hashes(dict):
    """word -> 64-bit hash, forgotten when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.strip(PUNCTUATION))
        return h


def features(text: str | None, cache: Hashes) -> np.ndarray:
    """uint32 hashes with repeats: words, neighbours, and pairs that skip a word. None is an empty text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pairs = (h[:-1] * k2) ^ (h[1:] * k3)
    skips = (h[:-2] * k3) ^ (h[2:] * k2) ^ k1
    return (np.concatenate([h, pairs, skips]) * k1 >> np.uint64(32)).astype(np.uint32)


@dataclass
class Model:
    ids: np.ndarray  # sorted uint32
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        total = self.bias
        if len(self.ids) and len(found):
            at = np.searchsorted(self.ids, found)
            at[at == len(self.ids)] = 0
            total += float(self.weights[np.unique(at[self.ids[at] == found])].sum())
        return 1.0 / (1.0 + float(np.exp(-min(max(total, -30.0), 30.0))))


def learn(texts: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = L1, l2: float = 0.5, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """FTRL-proximal on binary features; ``texts`` are unique uint32 arrays in a fixed order."""
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1.0)
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    vocabulary, n = np.unique(np.concatenate(texts), return_counts=True)
    # a feature of n texts has n * epochs gradients, each below 1; up to l1 its weight never leaves 0
    vocabulary = vocabulary[n * epochs > l1]
    rows = []
    for t in texts:
        at = np.searchsorted(vocabulary, t).astype(np.int32)
        at[at == len(vocabulary)] = 0
        rows.append(at[vocabulary[at] == t] if len(vocabulary) else at[:0])
    z, g2 = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)  # the last is the bias, without L1
    rng = np.random.default_rng(seed)

    def weight(zi: np.ndarray, gi: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(gi)) / alpha + l2), 0.0)

    def bias() -> float:
        return float(-z[-1] / ((beta + np.sqrt(g2[-1])) / alpha))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, gi = z[at], g2[at]
            w, b = weight(zi, gi), bias()
            p = 1.0 / (1.0 + np.exp(-min(max(w.sum() + b, -30.0), 30.0)))
            g = p - labels[i]
            sigma = (np.sqrt(gi + g * g) - np.sqrt(gi)) / alpha
            z[at] = zi + g - sigma * w
            g2[at] = gi + g * g
            z[-1] += g - (np.sqrt(g2[-1] + g * g) - np.sqrt(g2[-1])) / alpha * b
            g2[-1] += g * g
    w = weight(z[:-1], g2[:-1])
    keep = np.flatnonzero(w)
    if len(keep) > MAX_WEIGHTS:
        return learn(texts, labels, alpha, beta, 2 * l1, l2, epochs, seed)
    return Model(vocabulary[keep], w[keep], bias())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled texts.

    Of ``labels`` (doc_id, toxic) about ``sample`` ids are drawn by a hash of the id; an id
    with several labels takes the greatest, with several texts the greatest text, so repeated
    rows count once. Null labels and ids are left out; a null text is an empty one; a very long
    text is read whole. Without labels or documents, or with one kind of label, the model scores
    a constant. Other columns, whatever their names, are ignored.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = saved(known.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    n = known.count()
    if n > sample:
        known = known.where(F.col("draw") < int(sample / n * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(known), "id")  # ``sample`` rows of three numbers
    rows = rows.groupBy("id", "draw", "y").agg(F.max("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for b in batches:
            found = [np.unique(features(t, cache)).tobytes() for t in b.column(3).to_pylist()]
            columns = [b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "draw", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (1, 0, 2, 3)), strict=True)]
        held.sort(key=lambda r: r[:3])
        m = learn([np.frombuffer(r[3], np.uint32) for r in held], np.array([r[2] for r in held], float))
        yield pa.RecordBatch.from_arrays([pa.array([m.ids.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.bias])], names=["ids", "weights", "bias"])
        del held
        trim()

    got = rows.mapInArrow(extract, "id long, draw long, y int, f binary").repartition(1).mapInArrow(fit, "ids binary, weights binary, bias double").first()
    return Model(np.frombuffer(bytes(got["ids"]), np.uint32), np.frombuffer(bytes(got["weights"]), np.float64), got["bias"])


def toxicity_score(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1.

    Null and empty texts are scored as texts without words; a very long text is scored whole;
    equal texts have equal scores, so repeated rows and ties agree; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Hashes()
        for texts in batches:
            yield pd.Series([model.score(features(t, cache)) for t in texts], dtype="float64")
        cache.clear()
        trim()

    return score(text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


THRESHOLD = 0.3


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
