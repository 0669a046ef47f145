"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of two to four characters of a text in lower case, with
everything but letters as a space; each is hashed into a slot with an embedding.
A text is the mean of its subwords' embeddings, a linear softmax gives the
languages. Embeddings and softmax are trained together by stochastic gradient
descent in numpy. For scoring both are multiplied out into one table of logits
for each slot, which is all the executors get.

A fifth of the sample isn't trained on: it fits the temperature that makes
scores probabilities, and the score under which a prediction counts as
rejected. The sample is bounded by language: PER_LANGUAGE texts and CHARACTERS of
each language in the mean (fewer if there are over LANGUAGES), one at least, chosen
by a hash of the id, whole and whatever their length. What the driver gets of a text
is its distinct slots and their counts, half a MB at most. Every language is learned.

Defined cases: null texts and texts without a letter are `und` with score 0 and
rejected; if there is nothing to learn from, every text is; rows with a null
language or id aren't learned from; of rows that repeat an id and language one is
learned from; repeated rows are predicted alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, release_memory, small_batches

BITS, WIDTH = 16, 8
#: What is learned from a language; the more languages than LANGUAGES, the less of each.
PER_LANGUAGE, CHARACTERS, LANGUAGES = 700, 6_000_000, 50
EPOCHS, RATE = 4, 20.0
#: Share of right predictions on the calibration rows that may fall under the rejection score.
REJECTED = 0.005
_PIECE = 200_000


@functools.cache
def _letters() -> np.ndarray:
    """1 for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def slots(text: str) -> tuple[np.ndarray, bool]:
    """The slots of all subwords of a text, and whether it has a letter."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64), False
    c = np.where(letter, c, np.uint32(32))
    inside = letter[:-1] | letter[1:]
    h = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    found = [h[inside]]
    for j, m in ((2, 0xC2B2AE3D), (3, 0x27D4EB2F)):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + c[j:] * np.uint32(m)
        found.append(h[inside[: len(h)]])
    x = np.concatenate(found)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (x >> np.uint32(32 - BITS)).astype(np.int64), True


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> dict:
    """The languages, the table of logits by slot, the bias, the temperature's inverse and the rejection score.

    counts: the distinct slots of each text and how often they occur.
    """
    names = sorted(set(langs))
    number = {name: i for i, name in enumerate(names)}
    bags = [(at, (n / n.sum()).astype(np.float32)) for at, n in counts]
    y = [number[lang] for lang in langs]
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    trained = {y[i] for i in used}
    alone = np.array([y[i] not in trained for i in held], bool)  # languages that would not be trained at all
    held, used = held[~alone], np.concatenate([used, held[alone]])
    E = rng.normal(0, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    V, b = np.zeros((WIDTH, max(len(names), 1)), np.float32), np.zeros(max(len(names), 1), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(used):
            at, share = bags[i]
            rows = E[at]
            v = share @ rows
            g = _softmax(v @ V + b)
            g[y[i]] -= 1
            E[at] = rows - np.float32(rate) * share[:, None] * (V @ g)
            V -= np.float32(rate / 40) * np.outer(v, g)
            b -= np.float32(rate / 400) * g
    table = E @ V
    scale, reject = 1.0, 0.0
    if len(held):
        logits = np.array([bags[i][1] @ table[bags[i][0]] + b for i in held])
        target = np.array([y[i] for i in held])
        loss = lambda s: -np.log(np.maximum(_softmax(logits * s)[np.arange(len(held)), target], 1e-12)).mean()
        scale = min((2.0**k for k in np.arange(-4, 6.1, 0.25)), key=loss)
        right = _softmax(logits * scale)
        right = right.max(axis=1)[right.argmax(axis=1) == target]
        reject = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return {"names": names, "table": table, "bias": b, "scale": scale, "reject": reject}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, characters: int = CHARACTERS) -> dict:
    """A model from a bounded sample of the rows outside the held-out fold that have a language."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.min(unit).alias("least")).cache()
    part = min(1.0, LANGUAGES / max(counts.count(), 1))
    share = F.least(F.lit(1.0), F.lit(part * per_language) / F.col("n"), F.lit(part * characters) / F.greatest("chars", F.lit(1)))
    table = counts.select("lang", (F.greatest("least", F.floor(F.lit(float(1 << 30)) * share)) + 1).alias("_limit"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, at, n = [], [], [], []
            for doc_id, text, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found, any_letter = slots(text)
                if any_letter:
                    x, k = np.unique(found, return_counts=True)
                    ids.append(doc_id)
                    langs.append(lang)
                    at.append(x.astype(np.uint16).tobytes())
                    n.append(k.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "lang", "at", "n"])

    bagged = known.join(table, "lang").filter(unit < F.col("_limit")).select("doc_id", "text", "lang").mapInArrow(bags, "doc_id long, lang string, at binary, n binary")
    # By Arrow: the bags are views of what arrived, not copies.
    rows = bagged.groupBy("doc_id", "lang").agg(F.min(F.struct("at", "n")).alias("bag")).select("doc_id", "lang", "bag.at", "bag.n").toArrow().combine_chunks()
    counts.unpersist()
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("lang", "ascending")]).to_pylist()
    at, n = ([np.frombuffer(x.as_buffer(), k) for x in rows.column(c)] for c, k in (("at", np.uint16), ("n", np.uint32)))
    langs = rows.column("lang").to_pylist()
    model = fit([(at[i], n[i]) for i in order], [langs[i] for i in order])
    del rows, at, n
    release_memory()
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row of `docs`; only the text is read for them."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names, table, bias, scale, reject = m["names"], np.ascontiguousarray(m["table"]), m["bias"], m["scale"], m["reject"]
        for b in batches:
            pred, score = [], []
            for text in b.column(1).to_pylist():
                found, any_letter = slots(text) if text else (None, False)
                if not any_letter or not names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = np.zeros(len(bias), np.float64)
                for i in range(0, len(found), _PIECE):
                    total += table[found[i : i + _PIECE]].sum(axis=0, dtype=np.float64)
                p = _softmax((total / len(found) + bias) * scale)
                best = int(p.argmax())
                pred.append(names[best])
                score.append(float(min(1.0, p[best])))
            rejected = [s < reject or n == "und" for s, n in zip(score, pred, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, per row of `docs`."""
    return predict(docs, train(docs, per_language)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
