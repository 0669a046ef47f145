"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import dedup, fingerprints, langid, licences, mixing, packing, pii, quality, secrets, toxicity
from gridloom.llm.common import crc_fold, held_out, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, kind int"
WORDS = "the of and tiou hean ering atble reed onth lyst inan shha".split()


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); two more columns clash with names inside the operators."""
    full = [(i, t, la, so, None if t is None else len(t), "x", 9) for i, t, la, so in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    return [
        (1, prose(1, 60), "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \n\t ", "en", "b"),
        (5, "één " * 4000, "fr", "a"),
        (6, prose(1, 60), "en", "c"),
        (7, prose(2, 500), "de", None),
        (7, prose(2, 500), "de", None),
        (8, "word", None, "b"),
        (None, prose(3, 30), "en", "a"),
        (9, "12345 !!! 😀 ###", "en", "a"),
    ]


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


ALL = {
    "fingerprints": fingerprints.compare_neighbours,
    "packing": lambda d: packing.pack(d, tokenizer_file()),
    "secrets": secrets.report,
    "pii": pii.report,
    "near_duplicates": dedup.near_duplicates,
    "mixing": mixing.mix,
    "mixed": mixing.mixed,
    "licences": licences.scan,
    "quality": quality.judge,
    "languages": langid.identify,
    "keep_one": dedup.keep_one,
    "redact": secrets.redact,
    "sanitise": pii.sanitise,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_and_empty_tables(spark, odd_rows, name):
    found = ALL[name](docs(spark, odd_rows)).count()
    if name not in ("packing", "mixed", "keep_one"):
        assert found == len(odd_rows)
    assert ALL[name](docs(spark, odd_rows).limit(0)).count() == 0


CLASHING = "_id _r _live _repo _spans _odd _rows _kept _at _own _new _row2 _ts _epochs _last _copies _copy _t _key size id band grp head component digest score n score_ taken kept spans value term entity".split()


@pytest.mark.parametrize("name", ["keep_one", "redact", "sanitise", "mixed", "keep_clean", *sorted(set(ALL) - {"keep_one", "redact", "sanitise", "mixed"})])
def test_clashing_columns(spark, odd_rows, name):
    plain = docs(spark, [*odd_rows, (50, "token = abcdefgh12345 and me@x.org", "en", "a")])
    clashing = plain.withColumns({c: F.lit(7) for c in CLASHING})
    model = (np.zeros(0, np.int32), np.zeros(0, np.float32), -1.0)
    run = (lambda d: toxicity.keep_clean(d, model)) if name == "keep_clean" else ALL[name]
    got = run(clashing)
    if name in ("keep_one", "redact", "sanitise", "mixed", "keep_clean"):
        assert got.columns == clashing.columns and all(r["_id"] == 7 and r["grp"] == 7 for r in got.collect())
        got = got.select(plain.columns)
    as_rows = lambda df: Counter(map(repr, df.collect()))
    if name != "packing":
        assert as_rows(got) == as_rows(run(plain))


def test_toxicity_odd_and_empty_tables(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    found = toxicity.classify(docs(spark, odd_rows), labels).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.classify(docs(spark, odd_rows).limit(0), labels.limit(0)).count() == 0


def test_fold(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (crc_fold(r["id"]) == 0) for r in got)


def test_consistent_samples_estimate_generalised_jaccard():
    rng = np.random.default_rng(0)
    s = fingerprints.sampler()
    estimates, truths = [], []
    for _ in range(80):
        h = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
        w = rng.integers(1, 6, 300)
        v = np.where(rng.random(300) < 0.4, rng.integers(1, 6, 300), w)
        a, b = slice(0, 240), slice(60, 300)
        left = dict(zip((h[a] >> np.uint64(47)).tolist(), w[a].tolist(), strict=True))
        right = dict(zip((h[b] >> np.uint64(47)).tolist(), v[b].tolist(), strict=True))
        keys = set(left) | set(right)
        truths.append(sum(min(left.get(k, 0), right.get(k, 0)) for k in keys) / sum(max(left.get(k, 0), right.get(k, 0)) for k in keys))
        estimates.append(fingerprints.likeness(s.signature(h[a], w[a]), s.signature(h[b], v[b])))
    assert abs(np.mean(estimates) - np.mean(truths)) < 0.02


@pytest.mark.parametrize("n", [20_000, 300_000])
def test_long_unrelated_texts_are_unlike(n):
    """Terms are told apart however many there are; half of the terms in common is a likeness of a third."""
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, 3 * n // 2, dtype=np.uint64) * np.uint64(2)
    s = fingerprints.Sampler(256)
    a, b, c = s.signature(h[:n]), s.signature(h[n // 2 :]), s.signature(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    assert fingerprints.likeness(a, c) < 0.02 and abs(fingerprints.likeness(a, b) - 1 / 3) < 0.1


def test_fingerprints_follow_descending_ids(spark):
    rows = [(i * 7 % 101, prose(i, 5 + i % 40), "en", "a") for i in range(101)]
    order = sorted(rows, reverse=True)
    got = by_id(fingerprints.compare_neighbours(docs(spark, rows)))
    for i, (doc_id, text, _, _) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        (r,) = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        mine, edited, other = (fingerprints.fingerprint(t) for t in (text, new, following))
        assert r["fingerprint"] == mine.astype(">u2").tobytes().hex()
        assert r["near_edited"] == fingerprints.likeness(mine, edited) and r["near_next"] == fingerprints.likeness(mine, other)


def test_fingerprint_of_a_single_document(spark):
    (r,) = fingerprints.compare_neighbours(docs(spark, [(5, "one two three four five six", "en", "a")])).collect()
    assert r["near_next"] == 1.0


def test_packing_is_an_exact_round_trip(spark, odd_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    texts = [*odd_rows, (20, "Don't STOP, it's 3.14!! ÄÖÜ ß Σίσυφος İstanbul á <|endoftext|> x\ty z", "en", "a"), *[(100 + i, prose(i, 300), "en", "a") for i in range(40)]]
    want = Counter(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, x, _, _ in texts)
    pieces = packing.pack(docs(spark, texts), tokenizer_file()).collect()
    ids = defaultdict(list)
    for _, x, _, _ in texts:
        e = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        ids[len(e)].append(e)
    for r in pieces:  # every piece is the stretch it says, of a document of that length
        assert any(zlib.crc32(e[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for e in ids[r["doc_tokens"]])
    assert sum(r["length"] for r in pieces) == sum(len(k) // 4 * n for k, n in want.items())
    windows = defaultdict(list)
    for r in pieces:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_bm25_returns_the_lexical_neighbour():
    a = [np.array(x, "<u4") for x in ([1, 2, 3, 50, 51, 52], [7, 8, 9, 10], [1, 4, 50, 51, 60], [7, 70, 71])]
    index = packing.Index(a)
    assert index.nearest(a[0], np.array([False, True, True, True])) == [2]
    assert index.nearest(a[1], np.array([True, False, True, True])) == [3]
    assert index.nearest(a[1], np.array([True, False, True, False])) == []


def test_bm25_scores_all_terms_of_the_query():
    """More than 24 rare terms are shared with one document, and other documents share only the more frequent ones."""
    a = [np.arange(60), np.arange(30), np.arange(30, 60), np.arange(40, 60), np.arange(100, 140)]
    a += [np.random.default_rng(i).integers(0, 200, 50) for i in range(20)]
    a = [x.astype("<u4") for x in a]
    counts, mean = [Counter(x.tolist()) for x in a], np.mean([len(x) for x in a])

    def score(i):
        total = 0.0
        for t in set(counts[0]) & set(counts[i]):
            df = sum(t in c for c in counts)
            norm = packing.K1 * (1 - packing.B + packing.B * len(a[i]) / mean)
            total += np.log(1 + (len(a) - df + 0.5) / (df + 0.5)) * counts[i][t] * (packing.K1 + 1) / (counts[i][t] + norm)
        return total

    want = sorted((i for i in range(1, len(a)) if score(i) > 0), key=lambda i: -score(i))
    assert packing.Index(a).nearest(a[0], np.arange(len(a)) > 0) == want
    short = packing.Index(a[:4])
    assert short.nearest(a[0], np.arange(4) > 0) == [1, 2, 3] and packing.Index(a[:3]).nearest(a[0], np.arange(3) > 0) == [1, 2]


def test_toxicity_learns_on_the_other_folds(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = prose(i, 40).split()
        for _ in range(3 * bad):
            words.insert(r.randrange(40), r.choice(["scumbag", "idiotic", "vermin"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(bad)))
    got = toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"]]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs(spark, rows), model).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    bags = [np.unique(np.append(rng.integers(10, 500, 20), 3 if y else 4)).astype(np.int32) for y in range(2) for _ in range(200)]
    at, w, _ = toxicity.fit(bags, [0] * 200 + [1] * 200)
    assert w[at == 3][0] > 0 > w[at == 4][0] and len(at) < 250


def _spans(text, patterns):
    out = []
    for k, (name, pattern, flags, ok) in enumerate(patterns):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text, flags) if ok(m)]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


SECRETS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
]


def _luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, lambda m: _luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]


def _junk(seed, alphabet, pieces, n):
    r = random.Random(seed)
    return "".join(r.choice(pieces) if r.random() < 0.5 else r.choice(alphabet) for _ in range(n))


def test_secret_spans_match_brute_force(spark):
    pieces = ["token", "Password", "api_key", "apikey", "secret", "passwd", "=", ": ", '"', "'", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "A+/b", " ", "é", "😀", "\n"]
    rows = [(i, _junk(i, "abKX09=_. é😀\n", pieces, 60), "en", "a") for i in range(300)]
    rows += [(900, "token=secret = abcdefgh1", "en", "a"), (901, "AKIA" * 9, "en", "a"), (902, "f" * 3000, "en", "a")]
    got = by_id(secrets.report(docs(spark, rows)))
    for i, text, _, _ in rows:
        want = _spans(text, SECRETS)
        assert got[i][0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text, want, got[i][0]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[i][0]["spans"].split(","))


def test_ownership_separates_examples(spark):
    example, live = "Xy12Zz34Qq56Ww78Ee90Rr12", "Ab98Cd76Ef54Gh32Ij10Kl98"
    rows = [(i, f"see {example} here {i}", "en", f"s{i % 8}") for i in range(40)] + [(100 + i, f"own {live} note {i}", "en", "s1") for i in range(3)]
    rows += [(200 + i, f"password={example}", "en", f"s{i}") for i in range(8)]
    got = by_id(secrets.report(docs(spark, rows)))
    assert got[3][0]["spans"] == "" and got[100][0]["spans"] == "opaque:4:28" and got[100][0]["n_live"] == 1
    assert got[200][0]["spans"] == "assign:0:33" and got[200][0]["n_example"] == 1
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    assert texts[100] == "own <OPAQUE> note 0" and texts[3] == rows[3][1] and texts[200] == f"password={example}"


def test_personal_spans_match_brute_force(spark):
    pieces = ["a.b@c.de", "@x-y.z", "x_y@", "1.2.3.4", "255.", "256", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (555) 555-0100", "+44", "378282246310005", " ", "-", ".", "_d@e.f", "é😀"]
    rows = [(i, _junk(i, "0123456789@.+-() ab", pieces, 40), "en", "a") for i in range(400)]
    rows += [(900, "a@b.c_d@e.f", "en", "a"), (901, "7" * 5000, "en", "a"), (902, "a@" + "b." * 4000 + "c", "en", "a"), (903, "x" * 50000, "en", "a"), (904, "000001.0255.3.4", "en", "a")]
    got = by_id(pii.report(docs(spark, rows)))
    for i, text, _, _ in rows:
        want = _spans(text, PII)
        assert got[i][0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text, want, got[i][0]["spans"])


def test_disclosing_terms(spark):
    rows = [(i, f"{prose(i, 20)} zebulon wrote from zeb@mail.org today {prose(i + 50, 20)}", "en", "a") for i in range(4)]
    rows += [(100 + i, prose(i, 50) + " today wrote from", "en", "a") for i in range(60)]
    got = by_id(pii.report(docs(spark, rows)))
    text = rows[0][1]
    terms = [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[0][0]["spans"].split(",")) if k == "term"]
    assert terms == ["zebulon"]
    assert all(r[0]["spans"] == "" for i, r in got.items() if i >= 100)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "<TERM> wrote from <EMAIL> today" in clean[0]
    far = pii.scan(docs(spark, rows), broadcast_terms=0)
    assert far.filter("exists(_spans, s -> s.kind = 4)").count() == 4


@pytest.mark.parametrize("broadcast_terms", [0, 1000])
def test_disclosing_terms_of_whole_texts(spark, broadcast_terms):
    """Far from the mention, short, with digits, and each occurrence; against brute force."""
    far = ["Kim", "A7", "zebulon", "x1@y.org"]
    rows = [(i, f"{far[0]} {prose(i, 40)} {far[2]} {prose(i + 20, 60)} zeb@mail.org, {prose(i + 40, 60)} {far[1]} KIM call+1 555 555 0100", "en", "a") for i in range(4)]
    rows += [(10, f"x1@y.org {prose(7, 30)} wrote", "en", "a"), (11, f"{prose(8, 30)} x1@y.org kim1.2.3.4", "en", "a"), (12, rows[0][1], "en", "b"), (12, rows[0][1], "en", "b")]
    rows += [(100 + i, prose(i, 50) + " wrote call", "en", "a") for i in range(60)]
    got = {i: r[0] for i, r in by_id(pii.scan(docs(spark, rows), broadcast_terms=broadcast_terms)).items()}

    words, outside, held = {}, {}, {}
    for i, text, _, _ in rows:
        base = [(s["start"], s["end"], s["kind"], text[s["start"] : s["end"]].lower()) for s in got[i]["_base"]]
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
        words[i], held[i] = {w for _, _, w in found}, {(k, v) for _, _, k, v in base}
        outside[i] = [(a, b, w) for a, b, w in found if not any(a < e and s < b for s, e, _, _ in base)]
    n, text_of = len(rows), {i: t for i, t, _, _ in rows}
    ids = [i for i, *_ in rows]
    want = defaultdict(set)
    for e in set().union(*held.values()):
        has = [i for i in ids if e in held[i]]
        for w in {w for i in has for _, _, w in outside[i]}:
            both = [i for i in has if any(w == x for _, _, x in outside[i])]
            n_t = sum(w in words[i] for i in ids)
            if len({text_of[i] for i in both}) >= 2 and np.log(len(both) * n / (n_t * len(has))) >= 0.9 * np.log(n / len(has)):
                for i in both:
                    want[i].update((a, b) for a, b, x in outside[i] if x == w)
    assert {text_of[0][a:b] for a, b in want[0]} == {"Kim", "KIM", "A7", "zebulon"}
    for i in text_of:
        assert {(s["start"], s["end"]) for s in got[i]["_spans"] if s["kind"] == 4} == want[i], i


def _brute_components(rows, width, percent):
    sets, up = {}, {}
    for i, text, _, _ in rows:
        if i is None:
            continue
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.setdefault(i, []).append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a in range(len(flat)):
        for b in range(a):
            (i, s), (j, t) = flat[a], flat[b]
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in sets}, {i: [len(s) for s in ss] for i, ss in sets.items()}


def _near_rows():
    r = random.Random(8)
    rows = []
    for g in range(6):
        base = prose(1000 + g, 80 + 30 * g).split()
        for _ in range(25):
            words = list(base)
            for _ in range(r.randrange(7)):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words).title() if r.random() < 0.2 else " ".join(words), "en", "a"))
    rows += [(500 + i, prose(i, 70), "en", "a") for i in range(20)] + [(600 + i, "same short text", "en", "a") for i in range(30)]
    return [*rows, (700, "", "en", "a"), (701, None, "en", "a"), (702, "short", "en", "a"), (703, "SHORT", "en", "a")]


@pytest.mark.parametrize("group_rows", [600, 10])
def test_near_duplicates_match_brute_force(spark, group_rows):
    """With 10 rows a group, groups go through the hub and the blocks."""
    rows = _near_rows()
    want, sizes = _brute_components(rows, 4, 80)
    for r in dedup.near_duplicates(docs(spark, rows), 4, 80, group_rows=group_rows).collect():
        assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
        assert r["n_shingles"] in sizes[r["doc_id"]]


def test_repeated_ids_are_one_node(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a, "en", "a"), (2, a, "en", "a"), (2, b, "en", "a"), (3, b, "en", "a"), (4, c, "en", "a")]
    got = by_id(dedup.near_duplicates(docs(spark, rows)))
    assert {i: r[0]["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert sorted(r["doc_id"] for r in dedup.keep_one(docs(spark, [*rows, (4, c, "en", "a")])).collect()) == [1, 4]


def test_circulant_signature():
    s = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    sig = dedup.signature(s)
    table = np.random.default_rng(97).permutation(1 << dedup.UNIVERSE_BITS)
    at = (s >> np.uint64(64 - dedup.UNIVERSE_BITS)).astype(int)
    assert all(sig[k] == table[(at + k) % (1 << dedup.UNIVERSE_BITS)].min() for k in range(0, len(sig), 37))


def test_mixing_meets_targets(spark):
    rows = [(i, prose(i, 5 + i % 60), "en", f"s{i % 7}" if i % 3 else "s0") for i in range(600)]
    got = mixing.mix(docs(spark, rows)).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want, weight, left, free = {}, dict(zip(sorted(size), [3, 1, 2] * 3, strict=False)), 1.5 * sum(size.values()), set(size)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        for s in over or free:
            want[s] = 2 * size[s] if s in over else share[s]
        left -= sum(2 * size[s] for s in over)
        free -= over or free
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(spark, rows), range_rows=2).collect()))
    words = Counter()
    for r in mixing.mixed(docs(spark, rows)).collect():
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - target[s]) <= 64 for s in size)


def test_mixing_shares_what_is_left_among_repeated_rows(spark, monkeypatch):
    """Identical rows can't be told apart: they share the end of the budget, however ranges are cut and sources dealt."""
    rows = [(7, prose(1, 40), "en", "a")] * 500 + [(i, prose(i, 30), "en", "b") for i in range(100, 200)] + [(None, prose(3, 9), None, None)] * 3
    want = mixing.mix(docs(spark, rows)).collect()
    target = {r["source"]: r["target"] for r in want}
    for s in target:
        assert abs(sum(r["taken"] for r in want if r["source"] == s) - target[s]) <= 500
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, want)) == sorted(map(str, mixing.mix(docs(spark, rows), range_rows=10).collect()))
    assert mixing.mixed(docs(spark, rows)).count() > 0


def test_mixing_takes_a_weight(spark):
    rows = docs(spark, [(i, prose(i, 30), "en", "a") for i in range(400)])
    got = mixing.mix(rows, weight=F.when(F.col("doc_id") < 100, F.lit(50.0)).otherwise(F.lit(0.5))).collect()
    share = [sum(r["taken"] for r in got if (r["doc_id"] < 100) == good) / sum(r["size"] for r in got if (r["doc_id"] < 100) == good) for good in (True, False)]
    assert share[0] > share[1]


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    varied = "The MIT—" + mit
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("IS HEREBY", "is\n  hereby"), "en", "a"), (2, varied, "en", "a"), (3, prose(1, 20) + "\n  RELEASED under the MIT Licence!\n" + prose(2, 20), "en", "a"), (4, "released under the mit license and more", "en", "a")]
    got = by_id(licences.scan(docs(spark, [*rows, rows[2]])))
    assert (got[1][0]["whole_text"], got[1][0]["licences"]) == ("MIT", "MIT")
    assert got[2][0]["licences"] == "" and got[4][0]["licences"] == ""
    assert [(r["whole_text"], r["licences"], r["n_notices"]) for r in got[3]] == [(None, "MIT", 1)] * 2


def test_licence_files(spark):
    """Files as they are found: title, copyright line and body, wrapped; bulleted; complete texts with and without their appendix."""
    texts = {name: text for name, text in licences.KNOWN[:5]}
    wrapped = {k: "\n".join(textwrap.wrap(v, 76)) for k, v in texts.items()}
    head = "\n\nCopyright (c) 2020 Someone\n\n"
    isc = texts["ISC"].replace("the above copyright", "the above\ncopyright").replace("copies. THE", "copies.\n\nTHE")
    complete = {f.stem: f.read_text() for f in (Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    rows = [("MIT", "MIT License" + head + wrapped["MIT"]), ("MIT", "The MIT License (MIT)" + head + wrapped["MIT"]), ("BSD-3-Clause", "BSD 3-Clause License" + head + wrapped["BSD-3-Clause"])]
    rows += [("ISC", "ISC License" + head + isc), ("BSD-2-Clause", head + "\n* Redistributions".join(re.split(r" [12]\. Redistributions", texts["BSD-2-Clause"])))]
    rows += list(complete.items())
    rows += [("Apache-2.0", complete["Apache-2.0"].split("APPENDIX:")[0]), ("GPL-3.0", complete["GPL-3.0"].split("How to Apply These Terms")[0])]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0"} <= set(complete)
    got = by_id(licences.scan(docs(spark, [(i, x, "en", "a") for i, (_, x) in enumerate(rows)])))
    assert [got[i][0]["whole_text"] for i in range(len(rows))] == [name for name, _ in rows]


def test_quality_counts_match_brute_force(spark, odd_rows):
    rows = [*odd_rows[:-2], *[(100 + i, "\n".join(random.Random(i).choice([prose(i % 4, 7), prose(i, 3), "", " ", "a | b"]) for _ in range(12)), "en", "a") for i in range(80)]]
    got = by_id(quality.judge(docs(spark, rows)))
    for i, text, _, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeated = len({j + k for j in range(len(w) - 4) if n[tuple(w[j : j + 5])] > 1 for k in range(5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated)
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * repeated > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_rejects_texts_that_lose_too_much(spark):
    clean = "One plain sentence stands here, long enough.\nAnother one follows it, of other words entirely."
    rows = [(1, clean, "en", "a"), (2, clean + "\nHome | About | Contact | Login | Help", "en", "a"), (3, "Home | About us | Contact | Sign in | Search | Sitemap | x | y | z | w | v | u\n" + "Fine words stand here.", "en", "a"), (4, clean.replace(" ", " ### "), "en", "a"), (5, clean.upper() + "!", "en", "a")]
    got = by_id(quality.judge(docs(spark, rows)))
    assert [got[i][0]["kept"] for i in range(1, 6)] == [True, True, False, False, False]
    assert got[2][0]["clean_text"] == clean


def test_languages(spark):
    parts = {"en": "the and of tion ing ed was".split(), "de": "der und ung sch keit ein ß".split(), "fr": "les été que eau oir è des".split()}
    rows = [(i, " ".join("".join(random.Random(i * 31 + j).choices(parts[la], k=2)) for j in range(12)), la, "a") for i, la in enumerate(["en", "de", "fr"] * 120)]
    got = langid.identify(docs(spark, [*rows, (5000, None, "en", "a"), (5001, "1234 !?", "en", "a")])).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held) / len(held) > 0.95
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] >= 5000)


def test_every_language_is_learned(spark):
    """More than 500 languages, the rarest last, and one with long texts only."""
    ids = [i for i in range(4000) if crc_fold(i)]
    rows = [(ids.pop(), prose(k, 5), f"l{k:03}", "a") for k in range(520) for _ in range(2)]
    rows += [(ids.pop(), "qwx zvk jqz " * 4000, "long", "a") for _ in range(40)] + [(ids.pop(), "abba", "z", "a")]
    model = langid.train(docs(spark, rows))
    assert model["names"] == sorted({r[2] for r in rows})
    assert {r["lang_pred"] for r in langid.predict(docs(spark, [(1, "qwx zvk jqz " * 20, None, "a")]), model).collect()} == {"long"}


def _mix64(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def test_ftrl_matches_a_scalar_one():
    """The rule written out for one coordinate at a time, kept in dictionaries."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 60, 12)).astype(np.int32), int(rng.random() < 0.3)) for _ in range(300)]
    model = toxicity.FTRL(bits=6, l1=1.5)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0 if i == 64 else 1.5
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for features, label in rows:
        model.learn(features, label)
        at = [*features.tolist(), 64]
        w = {i: weight(i) for i in at}
        g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (toxicity.POSITIVE_WEIGHT if label else 1)
        for i in at:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.z[:65], [z[i] for i in range(65)]) and np.allclose(model.weights(slice(None))[:65], [weight(i) for i in range(65)])


def test_toxicity_scores_match_brute_force(spark):
    import xxhash

    rng = np.random.default_rng(9)
    at = np.unique(rng.integers(0, 1 << toxicity.SLOT_BITS, 300_000)).astype(np.int32)
    model = (at, rng.normal(0, 1, len(at)).astype(np.float32), -0.25)
    weights = dict(zip(at.tolist(), model[1].tolist(), strict=True))
    texts = {i: prose(i, 30) + " Çà 12 ab3cd e-f" for i in range(40)} | {40: "", 41: "one", 42: "one TWO"}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [(i, t, "en", "a") for i, t in texts.items()]), model).collect()}
    for i, text in texts.items():
        h = [xxhash.xxh64_intdigest(w.encode(), 3) for w in re.findall(r"[^\W\d_]+", re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()))]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:])]
        skips = [(((a * 0x9E3779B97F4A7C15) % 2**64 ^ 0x5851F42D4C957F2D) + b) % 2**64 for a, b in zip(h, h[2:])]
        total = sum(weights.get(x, 0.0) for x in {_mix64(x) >> (64 - toxicity.SLOT_BITS) for x in h + pairs + skips})
        assert abs(got[i] - 1 / (1 + np.exp(0.25 - total))) < 1e-5


def test_language_scores_match_brute_force(spark):
    rng = np.random.default_rng(3)
    model = {"names": ["a", "b", "c"], "table": rng.normal(0, 1, (1 << langid.BITS, 3)).astype(np.float32), "bias": np.array([0.1, 0, -0.1], np.float32), "scale": 2.0, "reject": 0.4}
    texts = {i: prose(i, 12) + " Ünö 3x" for i in range(30)} | {30: "é", 31: "1 2"}
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, [(i, t, "en", "a") for i, t in texts.items()]), model).collect()}
    m = 2**32
    for i, text in texts.items():
        c = [ord(x) if x.isalpha() else 32 for x in f" {text.lower()} "]
        found = []
        for k in range(len(c) - 1):
            if c[k] == 32 and c[k + 1] == 32:
                continue  # a subword begins with a letter or just before one
            h = (c[k] * 0x9E3779B1 + c[k + 1] * 0x85EBCA77) % m
            found.append(h)
            for x, by in zip(c[k + 2 : k + 4], (0xC2B2AE3D, 0x27D4EB2F), strict=False):
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D + x * by) % m
                found.append(h)
        if all(x == 32 for x in c):
            assert got[i]["lang_pred"] == "und"
            continue
        logits = np.mean([model["table"][((x ^ (x >> 16)) * 0x7FEB352D % m) >> (32 - langid.BITS)] for x in found], axis=0, dtype=np.float64)
        p = np.exp((logits + model["bias"]) * model["scale"])
        p /= p.sum()
        assert got[i]["lang_pred"] == "abc"[p.argmax()] and abs(got[i]["score"] - p.max()) < 1e-5 and got[i]["rejected"] == (p.max() < 0.4)


def test_long_and_repeated_rows_are_learned_from(spark):
    """Texts of any length take part; rows that repeat an id bring one of them to the driver."""
    ids = [i for i in range(4000) if crc_fold(i)]
    rows = [(ids[k], (prose(k, 12000) + " ") * 2 + ("scumbag " * 5 if k % 2 else ""), "en", "a") for k in range(60)]
    labels = spark.createDataFrame([(ids[k], k % 2) for k in range(60)] + [(999_999_999, 1)] * 50, "doc_id long, toxic int")
    at, w, _ = toxicity.train(docs(spark, rows + rows[:2] * 300), labels)
    assert w[np.isin(at, toxicity.slots("scumbag"))].max() > 0


def test_many_matches_take_linear_time(spark):
    """100,000 matches of a pattern, and as many spans to keep apart or to put, within seconds."""
    import time

    from gridloom.llm import spans

    n = 100_000
    rows = spark.createDataFrame([(" ".join(f"{i % 256}.2.3.{i % 199}" for i in range(n)),), ("a1.2.3.4é 5.6.7.8",), ("",), ("no",)], "_text string")
    began = time.time()
    found = rows.select("_text", spans.find("_text", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").alias("a"), spans.find("_text", 2, "[0-9]+ [0-9]+").alias("b")).cache()
    for r in found.collect():
        for name, pattern in (("a", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("b", "[0-9]+ [0-9]+")):
            assert [(s["start"], s["end"], s["value"]) for s in r[name]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r["_text"])]
    put = found.withColumn("c", F.expr("filter(a, (s, i) -> i % 3 = 0)")).select("_text", "c", F.expr(spans.apart_sql("a", "b")).alias("alone"), F.expr(spans.apart_sql("a", "c")).alias("rest"), spans.replaced("_text", "a", ["X", "IP"]).alias("new"))
    for r in put.collect():
        matches = list(re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r["_text"]))
        assert r["new"] == re.sub(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "<IP>", r["_text"])
        assert [s["start"] for s in r["rest"]] == [m.start() for i, m in enumerate(matches) if i % 3]
        assert len(r["alone"]) == (len(matches) if len(matches) < 9 else 0)
    assert time.time() - began < 60
    found.unpersist()


@pytest.mark.parametrize("seed", range(6))
def test_spans_apart_match_brute_force(spark, seed):
    from gridloom.llm import spans

    r = random.Random(seed)
    make = lambda n: sorted((s, s + r.randrange(1, 9)) for s in r.sample(range(2000), n))
    a, b = make(r.choice([0, 3, 300])), make(r.choice([0, 2, 150]))
    row = spark.createDataFrame([([(*s, 3, "v") for s in a], [(*s, 0, None) for s in b])], f"a {spans.SPAN}, b {spans.SPAN}")
    got = row.select(F.expr(spans.apart_sql("a", "b")).alias("x")).first()["x"]
    assert sorted((s["start"], s["end"]) for s in got) == [s for s in a if not any(o[0] < s[1] and s[0] < o[1] for o in b)]


def test_quality_of_endless_menus(spark, tmp_path):
    """A menu line of 100,000 entries, with and without a word that is none; read from a file, as the JVM optimises constants away."""
    r = random.Random(1)
    entries = [r.choice(quality.MENU_WORDS) for _ in range(100_000)]
    rows = [(1, " | ".join(entries), "en", "a"), (2, " ".join(entries) + " other", "en", "a"), (3, "Contact us | About us » sign in", "en", "a"), (4, "contact usage pages here", "en", "a"), (5, " ".join(f"w{i}" for i in range(100_000)) + ".", "en", "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in quality.judge(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert [got[i]["n_failed_lines"] for i in range(1, 6)] == [1, 0, 1, 0, 0]
    assert got[5]["n_words"] == 100_000 and got[5]["n_repeat_words"] == 0 and got[5]["kept"]


def test_ids_are_those_of_the_tokenizer():
    """Special tokens' strings anywhere in a text, letters whose lower case ends in a mark, and odd mixtures of both."""
    from tokenizers import Tokenizer

    ids, whole = packing.WordIds(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    r = random.Random(2)
    parts = ["a", "İ", "TARİHİ", ".", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "\n", "\t", "é", "É!", "'s", "x,", "12", "<", "|>", "ß", "Σας", "😀", "é", "̇"]
    texts = ["a <|endoftext|> b", "TARİHİ.", "", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    for text, got in zip(texts, ids.of(texts), strict=True):
        assert got[:-1].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert ids.of(texts[:1])[0].tolist() == [320, 49407, 321, 1]


def test_a_list_of_many_names_in_two_texts(spark):
    """5,000 entities and 4,000 terms that stand in the same two texts are two classes, not twenty million pairs; each term gives them away."""
    names = " ".join(f"n{i}@x{i}.org" for i in range(5000))
    terms = [f"w{i}q" for i in range(4000)]
    rows = [(i, prose(i, 20), "en", "a") for i in range(40)]
    rows += [(100, f"{names} {' '.join(terms)} once", "en", "a"), (101, f"{' '.join(terms)} {names} alone", "en", "a")]
    got = by_id(pii.scan(docs(spark, rows)))
    for i in (100, 101):
        told = [s for s in got[i][0]["_spans"] if s["kind"] == 4]
        text = dict((r[0], r[1]) for r in rows)[i]
        assert {text[s["start"] : s["end"]] for s in told} == set(terms)


def test_every_stage_begins_by_cleaning_the_driver(monkeypatch):
    import corpus_pipeline

    class Cleaned(Exception):
        pass

    def clean(_):
        raise Cleaned

    monkeypatch.setattr(corpus_pipeline, "clean_driver", clean)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Cleaned):
            stage(None, None, "")
