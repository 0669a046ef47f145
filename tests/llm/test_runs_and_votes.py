"""Runs of words against brute force over all periods, and votes of neighbours against plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import knn, queries, runs

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(s, least_length=6, least_exponent=4):
    """Every maximal stretch of each period, of which the smallest counts."""
    n, out = len(s), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            part = s[i : j + q]
            if len(part) >= max(least_length, least_exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequences():
    r = random.Random(5)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 90:
        fib.append(fib[-1] + fib[-2])
    yield from ([], [0], [0] * 5, [0] * 6, fib[-1], fib[-1][::-1], [0, 1] * 30, [1, 0] * 3 + [0] * 9)
    for _ in range(1500):
        s = []
        for _ in range(r.randint(0, 8)):
            s += [r.randrange(3) for _ in range(r.randint(1, 6))] * r.randint(1, 8)
            if r.random() < 0.4:
                s += s[: r.randint(0, len(s))]
        yield s[:110]
    for _ in range(1500):
        yield [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 70))]


def test_next_smaller_and_runs():
    for s in sequences():
        for larger in (False, True):
            sign = -1 if larger else 1
            suffixes = [[sign * x for x in s[i:]] for i in range(len(s) + 1)]
            nss, shared = runs.next_smaller(s, larger)
            for i, j in enumerate(nss):
                assert j == next(k for k in range(i + 1, len(s) + 1) if suffixes[k] < suffixes[i])
                equal = 0
                while j + equal < len(s) and s[i + equal] == s[j + equal]:
                    equal += 1
                assert shared[i] == equal
        assert runs.runs(s) == brute_runs(s)
        assert runs.runs(s, 1, 3) == brute_runs(s, 1, 3)


class Counted:
    """A value that counts how often it is compared, and can't be hashed."""

    made = 0
    __hash__ = None

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.made += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.made += 1
        return self.v < other.v

    def __gt__(self, other):
        Counted.made += 1
        return self.v > other.v


@pytest.mark.parametrize("n", [2000, 40000])
def test_comparisons_are_linear(n):
    ladder = [x for i in range(int(n**0.5), 0, -1) for x in [0] * i + [1]]
    for s in ([0] * n, [i % 2 for i in range(n)], ([0] * 50 + [1]) * (n // 51), [bin(i).count("1") % 2 for i in range(n)], ladder, ladder[: len(ladder) // 4] * 4, [((i + 1) & -(i + 1)).bit_length() for i in range(n)]):
        Counted.made = 0
        runs.runs([Counted(x) for x in s])
        assert Counted.made < 12 * len(s)


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    listing = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def prose(r, n):
    out = []
    while len(out) < n:
        unit = [r.choice("the of and tiou hean ering été 😀".split()) for _ in range(r.randint(1, 5))]
        out += unit * (r.randint(4, 7) if r.random() < 0.1 else 1)
    return r.choice([" ", "\n", "\x0b "]).join(out)


def test_report_of_odd_tables(spark):
    """Ids whose hash plants a repetition and others, nulls, empty and long texts, non-breaking spaces, repeated rows."""
    r = random.Random(8)
    rows = [(i, prose(r, r.randint(0, 80))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b\x0c\r "), (None, "a b " * 9), (1003, "x x " * 8), (1004, "a " * 5), (1005, "a " * 6), (1006, "one two " * 4000), (1007, prose(r, 3000)), (1008, "a b " * 9), (1008, "a b " * 9), (1009, "\x1c \x1c\x1c\x85 " * 8)]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA).repartition(5)
    found = runs.report(df.withColumn("n_runs", F.lit("x")).withColumn("start", F.lit(1)), plant=True)
    assert [f.name for f in found.schema] == [f.split()[0] for f in runs.FIELDS.split(", ")]
    assert Counter(map(tuple, found.collect())) == Counter(expected_row(*x) for x in rows)
    plain = {x["doc_id"]: x for x in runs.report(df).collect()}
    assert plain[1006]["n_runs"] == 1 and plain[1006]["length"] == 8000 and plain[1004]["n_runs"] == 0 and plain[1005]["n_runs"] == 1
    assert runs.report(df.limit(0)).count() == runs.without_repetitions(df.limit(0)).count() == runs.spans(df.limit(0)).count() == 0
    every = {(x["doc_id"], x["start"], x["length"], x["period"]) for x in runs.spans(df).collect()}
    assert every == {(i, *x) for i, t in rows for x in brute_runs((t or "").encode().split())}
    cleaned = {x["doc_id"]: x for x in runs.without_repetitions(df.withColumn("_row", F.lit(3))).collect()}
    assert cleaned[1006]["text"] == "one two" and cleaned[1000]["text"] is None and cleaned[1002]["text"] == rows[302][1] and cleaned[1006]["_row"] == 3
    assert len(cleaned[1008]["text"].split()) == 2


def test_votes_against_loops():
    r = np.random.default_rng(3)
    labelled = knn._unit(r.standard_normal((70, 6)).astype(np.float32))
    labelled[5] = labelled[9] = labelled[11]  # ties
    model = knn.Model(np.zeros(1), np.zeros((1, 6)), labelled, r.integers(0, 2, 70), np.array([3.0, 1.25]), 0.25)
    asked = knn._unit(r.standard_normal((600, 6)).astype(np.float32))
    asked[7], asked[8] = 0, labelled[9]
    got = knn.vote(model, asked, neighbours=4, power=3)
    for x, score in zip(asked, got, strict=True):
        near = sorted(((-round(float(np.float32(c)), 5), i) for i, c in enumerate(labelled @ x)))[:4]
        votes = [(max(-c, 0) ** 3 * model.weights[model.labels[i]], model.labels[i]) for c, i in near]
        want = sum(v * y for v, y in votes) / sum(v for v, _ in votes) if x.any() and sum(v for v, _ in votes) else 0.25
        assert abs(score - want) < 0.02


def test_latent_space_is_that_of_the_dense_matrix():
    """The subspace iteration finds the leading singular values of the weighted matrix."""
    r = random.Random(1)
    bags = [knn.bag(" ".join(r.choice(("alpha beta gamma", "one two three")[k % 2].split()) for _ in range(30))) for k in range(60)]
    model = knn.fit(bags, np.arange(60) % 2, dimensions=4)
    dense = np.zeros((60, knn.SLOTS))
    for row, (at, c) in zip(dense, bags, strict=True):
        row[at] = knn._weights(at, c, model.idf)
    _, want, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.linalg.norm(dense @ model.basis, axis=0), want[:4], rtol=0.02)
    assert np.allclose(model.basis.T @ model.basis, np.eye(4), atol=1e-4)
    assert ((knn.vote(model, model.vectors) >= 0.5) == (np.arange(60) % 2 == 1)).all()


def test_quality_of_held_out_documents(spark):
    found = queries.op12_quality_votes(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in rows)
    tested = [x for x in rows if x["held_out"]]
    good = [x["score"] for x in tested if x["quality"] == 1]
    bad = [x["score"] for x in tested if x["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([x["predicted"] == x["quality"] for x in tested]) > 0.95


def test_votes_of_odd_tables(spark):
    rows = [(1, "a good text of words", "en", "a", 1), (1, "a good text of words", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id", "en", "a", 5), (4, "été " * 40000, "fr", "a", 1), (5, "### $$$", "en", "a", 1), (6, "### $$$ %%%", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("score", "slots", "counts", "quality", "_quality", "row", "held_out")}).repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (99, 0), (5, 0), (6, 0)], "doc_id long, quality int")
    found = knn.classify(df, labels).collect()
    assert len(found) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in found)
    assert len({x["score"] for x in found if x["doc_id"] == 1}) == 1
    assert {x["score"] for x in knn.classify(df, labels.limit(0)).collect()} == {0.5}
    assert knn.classify(df.limit(0), labels).count() == 0
