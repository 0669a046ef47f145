"""Document fingerprints by consistent weighted sampling.

The terms of a text are its pairs of neighbouring words (A-Z in lower case; the
word itself in a text of one word), weighted by how often they occur. For each
of SAMPLES coordinates every term has two gamma variates r and c (shape 2) and a
uniform b, all fixed by the term and the coordinate. With t = floor(ln w / r + b),
the term with the least ln c - r (t - b) - r gives the coordinate (term, t), and
two texts agree in a coordinate with the probability of their generalised
Jaccard similarity, sum of min(w) / sum of max(w).

The variates are hashed from both halves of a term's 64 bits and the coordinate, and a
coordinate's code from all 64 bits, so texts of any length share only the terms they
have in common. A text and its edited text are fingerprinted together: terms that both
have with the same weight are looked at once. Coordinates are kept as 16 bits,
so unequal ones agree by chance once in 65,536.

Comparing neighbours in the order of ids needs no global sort: ids are cut into
ranges by their quantiles, a range is one run of rows of a task, and the rows
with the greatest id of a range are also sent to the range before it, as the
end of that run. A task holds one Arrow batch and one text besides.

Defined cases: null texts are empty; all empty texts have the same fingerprint,
unlike any other's; null ids come last in the order; rows with the same id come
by a hash of their text; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, small_batches, shingle_hashes

SAMPLES = 64
#: Ranges of ids for each shuffle partition, so that ranges spread evenly over the tasks.
RANGES_PER_PARTITION = 8
_SEED = 20_240_501
_CHUNK = 512


def _ordered(log_a: np.ndarray) -> np.ndarray:
    """Floats as unsigned integers in the same order, in the upper half of 64 bits."""
    return (log_a.astype(np.float32) + np.float32(128)).clip(0).view(np.uint32).astype(np.uint64) << np.uint64(32)


def _codes(terms: np.ndarray, t: np.ndarray | int) -> np.ndarray:
    """What a coordinate (term, t) is kept as, in the lower half of 64 bits: 16 bits, never 0."""
    x = terms * np.uint64(0x9E3779B97F4A7C15) + np.asarray(t).astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)


def _small_gamma(p: np.ndarray) -> np.ndarray:
    """The quantile of the gamma distribution of shape 2 for small p, where 1 - (1 + c) exp(-c) = p."""
    root = np.sqrt(2 * p)
    return root + root**2 / 3 + 11 * root**3 / 72


#: A table of so many bits stays in the fastest cache.
_TABLE_BITS = 12


@functools.cache
def _gamma_quantiles() -> np.ndarray:
    """The quantiles (k + 1/2) / 2^TABLE_BITS of the gamma distribution of shape 2, by Newton's method."""
    p = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
    c = np.where(p < 0.05, _small_gamma(p), 1 - np.log1p(-p))
    for _ in range(60):
        c = np.maximum(c - (1 - (1 + c) * np.exp(-c) - p) / np.maximum(c * np.exp(-c), 1e-12), c / 2)
    return c


#: Quantiles below which the lower bits of a variate count too, so that the least of many texts' terms are told apart.
_FINE = 64


class Sampler:
    """Consistent weighted samples of hashed terms."""

    def __init__(self, samples: int = SAMPLES, seed: int = _SEED):
        self.samples = samples
        self.keys = np.random.default_rng(seed).integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        quantiles = _gamma_quantiles()
        self.minus_r, self.log_c = -np.maximum(quantiles, 1e-3).astype(np.float32), np.log(quantiles).astype(np.float32)

    def _variates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """-r, b and ln c of each term and coordinate, from three 32-bit words hashed from both halves of the term."""
        x = (terms & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] * self.keys
        x ^= (terms >> np.uint64(32)).astype(np.uint32)[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        y = x * np.uint32(0x297A2D39)
        y ^= y >> np.uint32(16)
        z = y * np.uint32(0x85EBCA6B)
        z ^= z >> np.uint32(16)
        r = self.minus_r.take(x >> np.uint32(32 - _TABLE_BITS))
        c = self.log_c.take(z >> np.uint32(32 - _TABLE_BITS))
        fine = np.flatnonzero(z.ravel() < np.uint32(_FINE << (32 - _TABLE_BITS)))
        c.ravel()[fine] = np.log(_small_gamma((z.ravel()[fine] + 0.5) / 2.0**32))
        b = (y >> np.uint32(8)).astype(np.float32)
        b += np.float32(0.5)
        b *= np.float32(2.0**-24)
        return r, b, c

    def least(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each coordinate the least key of distinct terms; the least of two sets is that of their union."""
        least = np.full(self.samples, np.iinfo(np.uint64).max, np.uint64)
        for one in (True, False):  # t is 0 where the weight is 1
            mine = np.flatnonzero((weights == 1) == one)
            for i in range(0, len(mine), _CHUNK):
                s = terms[mine[i : i + _CHUNK]]
                r, b, log_a = self._variates(s)  # r is negative here
                if one:
                    t = np.zeros((len(s), 1), np.int64)
                    np.subtract(np.float32(1), b, out=b)
                    b *= r
                    log_a += b
                else:
                    t = np.floor(b - np.log(weights[mine[i : i + _CHUNK]].astype(np.float32))[:, None] / r)
                    log_a += r * (t - b + np.float32(1))
                # Only the least of each coordinate takes part, so only they get a code; ties go to the least code.
                low = log_a.min(axis=0)
                at, k = np.divmod(np.flatnonzero(log_a == low), self.samples)
                of = t[at, 0] if one else t[at, k]
                np.minimum.at(least, k, _ordered(low[k]) | _codes(s[at], of))
        return least

    def signature(self, hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """SAMPLES 16-bit coordinates of a bag of term hashes; of distinct hashes with weights, if given."""
        if weights is None:
            hashes, weights = np.unique(hashes, return_counts=True)
        return self.signatures((hashes, weights))[0]

    def signatures(self, *bags: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """The signatures of one or two bags of distinct terms with weights; what both have is looked at once."""
        bags = tuple((terms.astype(np.uint64), weights) for terms, weights in bags)
        if len(bags) == 1:
            leasts = [self.least(*bags[0])]
        else:
            (s, w), (t, v) = bags
            at = np.minimum(np.searchsorted(t, s), max(len(t) - 1, 0))
            same = (t[at] == s) & (v[at] == w) if len(t) else np.zeros(len(s), bool)
            other = np.ones(len(t), bool)
            other[at[same]] = False
            shared = self.least(s[same], w[same])
            leasts = [np.minimum(shared, self.least(s[~same], w[~same])), np.minimum(shared, self.least(t[other], v[other]))]
        none = np.zeros(self.samples, np.uint16)
        return [(x & np.uint64(0xFFFF)).astype(np.uint16) if len(terms) else none for x, (terms, _) in zip(leasts, bags, strict=True)]


@functools.cache
def sampler() -> Sampler:
    return Sampler()


@functools.cache
def _words() -> WordHash:
    return WordHash()


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(_words().of(text.encode("utf-8", "surrogatepass").lower().split()), 2), return_counts=True)


def fingerprint(text: str) -> np.ndarray:
    return sampler().signatures(_bag(text))[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal coordinates: the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, borrowed, doc_id, text) in order; each row that isn't borrowed, with the one after it in its range.

    A row's fingerprint comes with that of its edited text, which needs the next row; so
    its likeness to the next row's waits for the row after that.
    """
    held: tuple | None = None  # the last row: range, id, text, terms
    waiting: list | None = None  # the result before it, and its fingerprint
    for batch in batches:
        out: list[tuple] = []

        def told(next_print: np.ndarray, out: list[tuple] = out) -> None:
            if waiting:
                out.append((*waiting[0], likeness(waiting[1], next_print)))

        for part, borrowed, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            bag = None
            if held and held[0] == part:
                _, of, own, terms = held
                new = edited(own, text)
                own_print, new_print = sampler().signatures(terms, _bag(new)) if new != own else sampler().signatures(terms) * 2
                told(own_print)
                found = (of, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own_print.astype(">u2").tobytes().hex(), new_print.astype(">u2").tobytes().hex(), likeness(own_print, new_print))
                waiting = [found, own_print]
                bag = _bag(text)
            if borrowed:  # the end of a range
                if waiting:
                    told(sampler().signatures(bag if bag is not None else _bag(text))[0])
                held = waiting = None
            else:
                held = (part, doc_id, text, _bag(text) if bag is None else bag)
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """The fingerprints of each text and of its edited text, and their likenesses, by descending id.

    The text after the last one is the first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = max(2, int((partitions * RANGES_PER_PARTITION) ** 0.5))
    lowest = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(lowest)).cast("long").alias("_key"))
    # side^2 ranges by quantiles of the ids, looked up in two steps of `side` comparisons.
    steps = [i / (side * side) for i in range(1, side * side)]
    bounds = rows.agg(F.percentile_approx("_key", steps, max(10_000, 20 * side * side)).alias("b")).first()["b"] or []
    bounds = [*bounds, *[(1 << 63) - 1] * (side * side - len(bounds))]
    listed = lambda xs: "array(" + ", ".join(f"{x}L" if x != lowest else "(-9223372036854775807L - 1L)" for x in xs) + ")"
    ranged = rows.withColumn("_c", F.expr(f"least({side - 1}, size(filter({listed(bounds[side - 1 :: side])}, b -> b < _key)))"))
    ranged = ranged.withColumn("_range", F.expr(f"_c * {side} + size(filter(slice({listed(bounds)}, _c * {side} + 1, {side}), b -> b < _key))")).drop("_c")
    # One row for each range: its greatest id. The rows that have it end the range before, which has greater ids.
    tops = {r["_range"]: r["top"] for r in ranged.groupBy("_range").agg(F.max("_key").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's rows end the last range
    slots = side * side + 1
    top_of, to = (listed([d.get(i, 0) for i in range(slots)]) for d in (tops, before))
    sent = ranged.withColumn("_own", F.col("_range")).withColumn(
        "_range", F.explode(F.expr(f"IF(_key = get({top_of}, _range), array(_range, CAST(get({to}, _range) AS INT)), array(_range))"))
    )
    # Of a range's two copies of a row the second is borrowed; where there is one range only, both have the same number.
    borrowed = F.col("_range") != F.col("_own")
    if len(order) <= 1:
        first = ranged.withColumn("_borrowed", F.lit(False))
        top = tops[order[0]] if order else 0
        sent = first.unionByName(ranged.filter(F.col("_key") == F.lit(top)).withColumn("_borrowed", F.lit(True)))
    else:
        sent = sent.withColumn("_borrowed", borrowed)
    dealt = sent.repartition(partitions, "_range").sortWithinPartitions(F.desc("_range"), "_borrowed", F.desc("_key"), F.xxhash64("text"))
    return dealt.select("_range", "_borrowed", "doc_id", "text").mapInArrow(_compare, _SCHEMA)
