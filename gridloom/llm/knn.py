"""Quality scores by nearest-neighbour voting among labelled documents in a latent semantic space.

The terms of a text are of three families: its words in lower case without ASCII
punctuation and digits, hashed into 2^SLOT_BITS slots; the shapes of its words as
written (runs of small and capital letters, digits and single marks), hashed alike;
and what it repeats (a word again after one to four words, a line again), with the
shares of its words and lines that do so. A text's weights are 1 + ln(count) times
the inverse document frequency, each family at unit length; their projection to the
first DIMENSIONS singular vectors of the labelled documents, at unit length, is its
vector. The labelled vectors are broadcast. Every document is compared with all of
them exactly, block by block of documents, and its NEIGHBOURS nearest ones vote
with the POWER-th power of their cosines; each label's votes count in inverse
proportion to its share of the labelled documents.

The space and the labelled vectors come from a bounded sample: about SAMPLE labelled
documents of SAMPLE_CHARACTERS in all, chosen by a hash of the id, whole and
whatever their length, never of a held-out fold. The document frequencies are those
of the sample, as part of the model. What executors get is bounded by that: SAMPLE
vectors and SLOTS rows of the projection. Scoring is one narrow pass over the whole
texts.

Defined cases: null and empty texts have no words and repeat nothing, and are scored
as such; a text none of whose terms the sample has twice has no direction and gets
the share of label 1 among the labelled documents without a direction, or else of
all. Labels that are null or belong to no document are ignored, of several labels for
an id the greatest counts; of rows that repeat an id one is learned from; of equally
near neighbours those of the smallest ids vote; without any label every score is 0.5;
repeated rows score alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, release_memory, small_batches

SLOT_BITS = 14
DIMENSIONS = 64
NEIGHBOURS, POWER = 15, 4
#: Labelled documents of the space and the characters of their texts, in the mean at most.
SAMPLE, SAMPLE_CHARACTERS = 6000, 40_000_000
#: Documents of the sample that a term must stand in.
LEAST_SEEN = 2
#: Words apart at which a repetition is looked for, and the shares of words or lines repeated that are terms of their own.
GAPS, SHARES = (1, 2, 3, 4), (0.02, 0.05, 0.1, 0.2, 0.4)
SLOTS = (2 << SLOT_BITS) + (len(GAPS) + 1) * (1 + len(SHARES))
#: The first slot of each family, and the end.
FAMILIES = (0, 1 << SLOT_BITS, 2 << SLOT_BITS, SLOTS)
#: Documents of a block of products.
BLOCK = 256

_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_KINDS = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")


class _Shapes(WordHash):
    """The hash of a word's shape, by its characters' kinds."""

    def __missing__(self, kinds: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[kinds] = xxhash.xxh64_intdigest(_RUN.sub(rb"\1", kinds), self.seed)
        return value


@functools.cache
def _words() -> WordHash:
    return WordHash(seed=12)


@functools.cache
def _shapes() -> _Shapes:
    return _Shapes(seed=13)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text's terms, ascending, and how often each stands: first words, then shapes, then repetitions."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = _words().of((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    shapes = _shapes().of(raw.translate(_KINDS).split())
    shift = np.uint64(64 - SLOT_BITS)
    counts = np.zeros(SLOTS, np.int32)
    counts[: 1 << SLOT_BITS] = np.bincount((words >> shift).astype(np.int32), minlength=1 << SLOT_BITS)
    counts[1 << SLOT_BITS : 2 << SLOT_BITS] = np.bincount((shapes >> shift).astype(np.int32), minlength=1 << SLOT_BITS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = [int((words[g:] == words[:-g]).sum()) for g in GAPS] + [len(lines) - len(set(lines))]
    for k, (repeated, of) in enumerate(zip(repeats, [len(words)] * len(GAPS) + [len(lines)], strict=True)):
        own = counts[(2 << SLOT_BITS) + k * (1 + len(SHARES)) :]
        own[0] = 1 + repeated
        own[1 : 1 + len(SHARES)] = repeated > np.array(SHARES) * of
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found]


class Model(NamedTuple):
    idf: np.ndarray  # of each slot; 0 where the sample doesn't have it often enough
    basis: np.ndarray  # slots x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, at unit length or 0
    labels: np.ndarray
    weights: np.ndarray  # of the votes of each label
    without: float  # the score of a text without a direction


def _weights(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a text's terms, each family at unit length."""
    w = ((1 + np.log(counts)) * idf[slots]).astype(np.float32)
    for part in np.split(w, np.searchsorted(slots, FAMILIES[1:-1])):
        part /= np.sqrt(part @ part) or 1
    return w


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norms > 1e-6, x / np.maximum(norms, 1e-6), 0).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """The latent space of labelled bags by subspace iteration, block by block, and their vectors."""
    n = len(bags)
    if not n:
        return Model(np.zeros(SLOTS, np.float32), np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), labels, np.ones(2), 0.5)
    seen = np.zeros(SLOTS, np.int64)
    for at, _ in bags:
        seen[at] += 1
    idf = np.where(seen >= LEAST_SEEN, np.log((1 + n) / (1 + seen)) + 0.1, 0).astype(np.float32)
    used = np.flatnonzero(idf)
    place = np.cumsum(idf > 0) - 1
    blocks = [bags[k : k + BLOCK] for k in range(0, n, BLOCK)]

    def dense(block: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(block), len(used)), np.float32)
        for row, (at, counts) in zip(out, block, strict=True):
            w = _weights(at, counts, idf)
            row[place[at[w > 0]]] = w[w > 0]
        return out

    rank = max(1, min(dimensions + 16, n, len(used)))
    basis = np.random.default_rng(12).standard_normal((len(used), rank)).astype(np.float32)
    for _ in range(4 if len(used) else 0):
        basis = np.linalg.qr(basis)[0]
        after = np.zeros_like(basis)
        for b in blocks:
            x = dense(b)
            after += x.T @ (x @ basis)
        basis = after
    basis = np.linalg.qr(basis)[0] if len(used) else basis
    y = np.concatenate([dense(b) @ basis for b in blocks])
    _, strengths, turn = np.linalg.svd(y, full_matrices=False)
    turn = turn[:dimensions][strengths[:dimensions] > 1e-6]
    whole = np.zeros((SLOTS, max(1, len(turn))), np.float32)
    if len(turn) and len(used):
        whole[used] = basis @ turn.T
        vectors = _unit(y @ turn.T)
    else:
        vectors = np.zeros((n, 1), np.float32)
    share = np.array([(labels == k).mean() for k in (0, 1)])
    blank = ~vectors.any(axis=1)
    return Model(idf, whole, vectors, labels, np.where(share > 0, 1 / np.maximum(share, 1e-12), 1.0), float(labels[blank].mean() if blank.any() else labels.mean()))


def project(model: Model, texts: list[str | None]) -> np.ndarray:
    """The vectors of texts: weighted sums of the basis' rows."""
    out = np.zeros((len(texts), model.basis.shape[1]), np.float32)
    for row, text in zip(out, texts, strict=True):
        at, counts = bag(text)
        row[:] = _weights(at, counts, model.idf) @ model.basis[at]
    return _unit(out)


def vote(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
    """The score of each vector: products with all labelled ones, a block at a time."""
    out = np.full(len(vectors), model.without)
    if not len(model.labels):
        return out
    k = min(neighbours, len(model.labels))
    for start in range(0, len(vectors), BLOCK):
        block = vectors[start : start + BLOCK]
        # Rounded, so that copies of a document tie whatever the block's shape.
        cosines = np.round(block @ model.vectors.T, 5)
        # The k-th largest cosine; of those equal to it the first ones vote.
        least = np.partition(cosines, -k, axis=1)[:, -k][:, None]
        above, level = cosines > least, cosines == least
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        rows, at = np.nonzero(chosen)
        w = np.maximum(cosines[rows, at].astype(np.float64), 0) ** power * model.weights[model.labels[at]]
        total = np.bincount(rows, w, len(block))
        good = np.bincount(rows, w * model.labels[at], len(block))
        some = (total > 0) & block.any(axis=1)
        out[start : start + BLOCK][some] = (good[some] / total[some]).clip(0, 1)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the rows the model doesn't learn from: crc32 of the id's digits, modulo 3, is 1; also for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> Model:
    """A model from a sample of the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    texts = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    total = texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")).join(known, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    # A threshold on a hash of the id: the same documents whatever the partitions.
    share = min(1.0, sample / max(total["rows"], 1), characters / max(total["n"] or 0, 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bag(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], names=["doc_id", "quality", "slots", "counts"])
        _words().clear()
        _shapes().clear()
        release_memory()

    bagged = texts.filter(chosen).join(known.filter(chosen), "doc_id").select("doc_id", "text", "_quality").mapInArrow(bags, "doc_id long, quality int, slots binary, counts binary")
    rows = bagged.groupBy("doc_id").agg(F.min(F.struct("slots", "counts", "quality")).alias("row")).select("doc_id", "row.*").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    slots, counts = ([np.frombuffer(x.as_buffer(), np.int32) for x in rows.column(c)] for c in ("slots", "counts"))
    quality = (rows.column("quality").to_numpy() > 0).astype(np.int64)
    model = fit([(slots[i], counts[i]) for i in order], quality[order])
    del rows, slots, counts
    release_memory()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of `docs`; nothing but the text is read for the score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = vote(shared.value, project(shared.value, b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])
        _words().clear()
        _shapes().clear()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, per row of `docs`."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
