"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, pairs of neighbouring words
and pairs of words with one word between, in lower case without ASCII
punctuation and digits, hashed into 2^SLOT_BITS slots. FTRL-proximal keeps a
learning rate for each coordinate and an L1 penalty, so most weights are exactly
0; the others, a few thousand pairs at most, are what the executors get.

The model learns on the driver from a bounded sample: about SAMPLE labelled
documents of SAMPLE_CHARACTERS in all, chosen by a hash of the id, whole and
whatever their length, never of a held-out fold. What the driver gets of a text is
its distinct slots, 4 MB at most. Scoring is one narrow pass over the whole texts.

Defined cases: null and empty texts get the score of no features; labels that
are null or belong to no document are ignored, of several labels for an id the
greatest counts; of rows that repeat an id one is learned from; without any
label every score is 0.5 and predicts 0; repeated rows score alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, held_out, mix64, release_memory, small_batches

SLOT_BITS = 20
#: Labelled documents the model learns from and the characters of their texts, in the mean at most.
SAMPLE, SAMPLE_CHARACTERS = 8000, 60_000_000
EPOCHS, ALPHA, BETA, L2 = 10, 2.0, 1.0, 0.1
#: The L1 penalty and the documents a feature must stand in grow with the sample.
L1_SHARE, LEAST_L1, SEEN_SHARE, LEAST_SEEN = 1 / 1000, 8.0, 1 / 450, 3
#: Toxic texts are the fewer: each counts so many times.
POSITIVE_WEIGHT = 6.0

_TABLE = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


@functools.cache
def _words() -> WordHash:
    return WordHash(seed=3)


def slots(text: str | None, bits: int = SLOT_BITS) -> np.ndarray:
    """The slots of all features of a text, with repetitions."""
    h = _words().of((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())
    pair = h * np.uint64(0x9E3779B97F4A7C15)
    parts = [h, pair[:-1] + h[1:], (pair[:-2] ^ np.uint64(0x5851F42D4C957F2D)) + h[2:]]
    return (mix64(np.concatenate(parts)) >> np.uint64(64 - bits)).astype(np.int32)


class FTRL:
    """Logistic regression by the FTRL-proximal rule; slot 2^bits is the bias, which has no penalty."""

    def __init__(self, bits: int = SLOT_BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = LEAST_L1, l2: float = L2):
        self.n, self.z = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias, self.alpha, self.beta, self.l1, self.l2 = 1 << bits, alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        if isinstance(at, slice):
            l1[self.bias] = 0
        else:
            l1[at == self.bias] = 0
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, self.bias)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= POSITIVE_WEIGHT if label else 1.0
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(features: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias."""
    model = FTRL(l1=LEAST_L1 + len(labels) * L1_SHARE)
    if features:
        seen = np.zeros(1 << SLOT_BITS, np.int32)
        for f in features:
            seen[f] += 1  # a text's slots are distinct
        features = [f[seen[f] >= max(LEAST_SEEN, len(labels) * SEEN_SHARE)] for f in features]
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            model.learn(features[i], labels[i])
    bias = float(model.weights(np.array([model.bias]))[0]) if labels else -1e-9
    kept = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)  # those with a weight, 2^SLOT_BITS at most, 8 bytes each
    return kept.astype(np.int32), model.weights(kept).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from a sample of the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    texts = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    total = texts.select("doc_id", F.length("text").cast("long").alias("n")).join(known, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    # A threshold on a hash of the id: the same documents whatever the partitions.
    share = min(1.0, sample / max(total["rows"], 1), characters / max(total["n"] or 0, 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(slots(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "toxic", "slots"])
        _words().clear()
        release_memory()

    bagged = texts.filter(chosen).join(known.filter(chosen), "doc_id").select("doc_id", "text", "_toxic").mapInArrow(bags, "doc_id long, toxic int, slots binary")
    # By Arrow: the features are views of what arrived, not copies.
    rows = bagged.groupBy("doc_id").agg(F.min(F.struct("slots", "toxic")).alias("row")).select("doc_id", "row.slots", "row.toxic").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    bags_of = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("slots")]
    toxic = rows.column("toxic").to_numpy()
    model = fit([bags_of[i] for i in order], toxic[order].tolist())
    del rows, bags_of
    release_memory()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row of `docs`; nothing but the text is read for the score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << SLOT_BITS, np.float32)
        dense[at] = w
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                found = slots(text)
                found = np.unique(found[dense[found] != 0])
                out.append(1 / (1 + np.exp(-np.clip(float(dense[found].sum(dtype=np.float64)) + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])
        _words().clear()
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, per row of `docs`."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold, in one narrow pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << SLOT_BITS, np.float32)
        dense[at] = w
        limit = np.log(threshold / (1 - threshold)) - bias
        for b in batches:
            kept = []
            for text in b.column(column).to_pylist():
                found = slots(text)
                found = np.unique(found[dense[found] != 0])
                kept.append(float(dense[found].sum(dtype=np.float64)) < limit)
            yield b.filter(pa.array(kept, pa.bool_()))
        _words().clear()
        release_memory()

    return docs.mapInArrow(run, docs.schema)
