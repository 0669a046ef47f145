"""Periodic runs of words by Lyndon arrays, in the manner of Ellert and Fischer (linear-time runs over general ordered alphabets).

A run of period q that is at least twice as long holds a Lyndon word of length q,
for one of two opposite orders of the words, that ends where the next smaller
suffix starts. So the runs are read off the next smaller suffixes under both
orders. They are found from left to right by comparing each suffix with the one
before it and with that one's previous smaller suffixes. What two suffixes have in
common is never matched twice: within the furthest match reached so far a
comparison has been made already, one distance to the left, and its result is
reused; elsewhere it follows from the two known matches of a chain, and only what
lies beyond the furthest match is compared word by word. Words are only compared,
for order and equality: there are no hashes, suffix arrays or trees.

One narrow pass over whole texts; a text's arrays, some 100 bytes a word, are what
a task holds besides its batch.

Defined cases: a null or empty text, or one of white space, has no words and no
run; the end of the text is smaller than every word; the runs of a text depend on
nothing but its words, so repeated rows give equal results; runs of different
periods at the same place are different runs, and a run is never reported with a
multiple of its period; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, utf8

#: A run has at least so many words and at least so many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4


def next_smaller(s: Sequence, larger: bool = False) -> tuple[list[int], list[int]]:
    """For each position the start of the next smaller suffix and how many words both suffixes share.

    larger: under the opposite order of the words. In both orders the empty
    suffix, at len(s), is the smallest.
    """
    n = len(s)
    nss, shared = [n] * n, [0] * n
    pss, before = [-1] * n, [0] * n  # the previous smaller suffix, and the words shared with it
    reach, start, gap = 0, 0, 0  # the furthest match reached: it starts at `start`, and `gap` words before that as well
    for r in range(1, n):
        left, match = r - 1, -1
        while left >= 0:
            if r < reach and left >= start:
                # Within the match: the pair stood `gap` words to the left and was compared there.
                a, b = left - gap, r - gap
                match = shared[a] if nss[a] == b else before[b]
                if r + match >= reach:
                    match = reach - r
                    settled = False
                else:
                    settled = True
            elif match < 0:
                match, settled = 0, False
            else:
                # `match` is what r shares with the last one of the chain, whose previous smaller suffix `left` is.
                known = before[last]
                settled = match != known
                if known < match:
                    match = known
            if not settled:
                i = r + match
                j = left + match
                while i < n and s[i] == s[j]:
                    i += 1
                    j += 1
                match = i - r
                if i >= reach:
                    reach, start, gap = i, r, r - left
            i = r + match
            # Equal so far; the suffix that ends first is the smaller one.
            if i < n and (s[left + match] > s[i] if larger else s[left + match] < s[i]):
                break
            nss[left], shared[left] = r, match
            last, left = left, pss[left]
        pss[r] = left
        before[r] = match if left >= 0 else 0
    # What never met a smaller suffix is smaller than all after it, but for the empty one.
    return nss, shared


def runs(s: Sequence, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of `s` that are long enough, by start and period; least_exponent is 3 at least.

    Where a Lyndon word of length q stands at the leftmost place of its run, what
    precedes it in the run is shorter than q. So at most q words are compared to
    the left, once for each run under an order.
    """
    found = set()
    for larger in (False, True):
        nss, shared = next_smaller(s, larger)
        # Fewer than q words precede the leftmost Lyndon word, so that two and more periods follow its first one.
        follow = least_exponent - 2
        for at, length in enumerate(shared):
            if not length:
                continue
            q = nss[at] - at
            if length < follow * q:
                continue
            earlier = at - q
            if earlier >= 0 and nss[earlier] == at and shared[earlier] >= q:
                continue  # not the leftmost of its run
            begin, ahead = at, at + q
            while begin > 0 and s[begin - 1] == s[ahead - 1]:
                begin -= 1
                ahead -= 1
            total = at + q + length - begin
            if total >= least_length and total >= least_exponent * q:
                found.add((begin, total, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, and for one id in ten a repetition planted from some word on, as the id's hash says."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    n = len(words)
    steps = [0] * (n + 1)
    for start, length, q in found:
        steps[start + q] += 1
        steps[start + length] -= 1
    if not found:
        return words
    depth, kept = 0, []
    for step in steps[:n]:
        depth += step
        kept.append(not depth)
    return list(compress(words, kept))


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(doc_id: int | None, words: list[bytes]) -> tuple:
    found = runs(words)
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    listing = "".join(f"{a},{n},{q}\n" for a, n, q in found).encode()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, hashlib.sha256(listing).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())


def report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The number of runs of each text, its longest run, and digests of all runs and of the text without repetitions.

    plant: first write a repetition into one text of ten, as `planted` says.
    """
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                words = text.split()  # of bytes: at the space and U+0009 to U+000D
                rows.append(described(doc_id, planted(words, doc_id) if plant else words))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)


def without_repetitions(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated periods of each run taken out of the text; texts without a run stay as they are, null included."""
    small_batches(docs.sparkSession)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for old, text in zip(b.column(column).to_pylist(), utf8(b.column(column)), strict=True):
                words = text.split()
                found = runs(words)
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8") if found else old)
            yield b.set_column(column, b.schema.field(column), pa.array(texts, b.schema.field(column).type))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, length and period of every run, in words, one row for each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc_id, *r) for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True) for r in runs(text.split())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "period"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")
