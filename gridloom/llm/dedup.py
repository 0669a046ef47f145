"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A text's set is its distinct shingles of words, A-Z in lower case. Circulant
MinHash needs two permutations only: s scatters a shingle over a universe of
2^UNIVERSE_BITS places, p is one table of that size, and coordinate k of the
signature is the minimum over the set of p at (s(x) + k) modulo the universe.
So the coordinates of a shingle are neighbours in the table, and a signature is
the elementwise minimum of slices of it.

1. One pass over the texts gives a row of 8 bytes for each of BANDS bands, with
   the number of shingles and a 128-bit digest of the word sequence.
2. Texts of one digest are one class; its smallest id stands for it from here on.
3. Classes that share a band's value with others are candidates. Each value links
   its classes to the smallest one, and the components of those links are
   candidate groups; no group is ever spread into its pairs.
4. The texts of candidates are read once more for their sets. Groups of up to
   GROUP_ROWS classes and GROUP_SHINGLES shingles are settled in one task
   each: a union-find over exact intersections, which only skips pairs that are
   already connected or too different in size.
5. Larger groups are cut into blocks of those bounds. The class with the most
   shared bands is compared with all others first, which settles nearly all of
   a group of copies of one text; the rest is compared, block by block, with
   everything in its group. Memory per task stays bounded.
6. Links confirmed on full sets make the final components of classes; each row
   takes its class's.

Every decision rests on an exact intersection; banding only chooses what is
compared. With the default bands a pair of similarity 0.8 is missed with
probability 0.0002, and links of other pairs usually connect it all the same.

Defined cases: null texts and texts without words have 0 shingles and link with
nothing; a text with fewer words than a shingle has its whole sequence as its
only one; rows that repeat an id are linked (they are one node); a null id is
never linked and has no component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import clean_driver, cut_lineage
from .common import WordHash, release_memory, shingle_hashes, small_batches, unwrapped, utf8, wrapped

UNIVERSE_BITS = 20
BANDS, ROWS = 48, 8
#: What one task settles at a time.
GROUP_ROWS, GROUP_SHINGLES = 600, 400_000
#: Candidates up to which their ids are broadcast to the second pass (some 30 bytes each).
BROADCAST_ROWS = 1_000_000
_CHUNK = 2048


@functools.cache
def _windows() -> np.ndarray:
    """Row i: the coordinates of a shingle that the first permutation puts at i."""
    table = np.random.default_rng(97).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    k = BANDS * ROWS
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:k]]), k)


@functools.cache
def _words() -> WordHash:
    return WordHash(seed=7)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    x = shingle_hashes(_words().of(words), width)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def signature(shingles: np.ndarray) -> np.ndarray:
    """The circulant MinHash coordinates of a set that isn't empty. The hashes scatter the shingles (the first permutation)."""
    at = (shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    windows = _windows()
    least = windows[at[:_CHUNK]].min(axis=0)
    for i in range(_CHUNK, len(at), _CHUNK):
        np.minimum(least, windows[at[i : i + _CHUNK]].min(axis=0), out=least)
    return least


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def band_values(sig: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band, unlike those of other bands."""
    x = (sig.reshape(BANDS, ROWS).astype(np.uint64) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, bands = [], [], []
            for text in utf8(b.column(1)):
                words = words_of(text)
                s = shingle_set(words, width)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                bands.append(band_values(signature(s)) if len(s) else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "bands"])
        _words().clear()
        release_memory()

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct hashes."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


def _against(one: np.ndarray, sets: list[np.ndarray], which: list[int], percent: int) -> list[int]:
    """Those of `which` that are similar to `one`; their sets are looked up in it together."""
    n = len(one)
    fit = [j for j in which if 100 * min(n, len(sets[j])) >= percent * max(n, len(sets[j]))]
    if not fit:
        return []
    ends = np.cumsum([len(sets[j]) for j in fit])
    flat = np.concatenate([sets[j] for j in fit])
    hit = one[np.minimum(np.searchsorted(one, flat), n - 1)] == flat
    shared = np.diff(np.concatenate(([0], np.cumsum(hit)[ends - 1])))
    return [j for j, s in zip(fit, shared.tolist(), strict=True) if 100 * s >= percent * (n + len(sets[j]) - s)]


def settle(ids: list[int], sets: list[np.ndarray], degrees: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links of a group connect.

    The best connected come first; each is compared with all it isn't yet connected to.
    """
    order = sorted(range(len(ids)), key=lambda i: (-degrees[i], ids[i]))
    u, links = _Union(len(ids)), []
    for at, i in enumerate(order):
        root = u.find(i)
        for j in _against(sets[i], sets, [j for j in order[at + 1 :] if u.find(j) != root], percent):
            if u.find(i) != u.find(j):
                u.join(i, j)
                links.append((ids[i], ids[j]))
    return links


def _read(rows: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, per row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    sketched = cut_lineage(docs.select("doc_id", "text").mapInArrow(_sketches(width), "doc_id long, n_shingles long, digest binary, bands array<long>"), partitions_per_file=8)
    with_words = sketched.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = with_words.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    # An id that stands in rows of several classes joins them.
    in_several = with_words.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter(F.col("a") != F.col("b")).select("doc_id")
    held = with_words.join(in_several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "rep")
    repeated = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("src")), "doc_id").select("src", F.col("rep").alias("dst"))

    # All rows of a class have the same bands: the row of its smallest id speaks for it (of one id in several classes, each row).
    speakers = with_words.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    banded = speakers.select("doc_id", F.explode("bands").alias("band"))
    # Counted apart, so that adaptive execution may split a band that many classes share when it is joined.
    shared = cut_lineage(banded.groupBy("band").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), compact=True)
    starred = cut_lineage(banded.join(shared, "band").groupBy("doc_id", "head").agg(F.sum("n").alias("degree")))
    degrees = starred.groupBy(F.col("doc_id").alias("id")).agg(F.sum("degree").alias("degree"))
    groups = components(starred.select(F.col("head").alias("src"), F.col("doc_id").alias("dst"))).withColumnRenamed("component", "grp")
    sizes = speakers.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_shingles").alias("n_shingles"))
    members = cut_lineage(groups.join(degrees, "id").join(sizes, "id").select("id", "grp", "degree", "n_shingles"))
    clean_driver(spark)

    # Only large groups need their sizes; no group's members are dealt by their group to learn them.
    bounds = members.groupBy("grp").agg(F.count(F.lit(1)).alias("g_rows"), F.sum("n_shingles").alias("g_shingles"))
    large = cut_lineage(bounds.filter((F.col("g_rows") > group_rows) | (F.col("g_shingles") > group_shingles)), compact=True)
    n_large = large.count()
    if n_large <= BROADCAST_ROWS:
        large = F.broadcast(large)
    members = members.join(large, "grp", "left").select("id", "grp", "degree", "g_rows", "g_shingles")
    links = _settle_small(_with_sets(docs, members.filter(F.col("g_rows").isNull()), width), percent)
    if n_large:
        sets = cut_lineage(_with_sets(docs, members.filter(F.col("g_rows").isNotNull()), width), partitions_per_file=8)
        links = links.unionByName(_settle_large(sets, percent, group_rows, group_shingles))
    # The graph's nodes are classes, by their smallest ids; a row has the component of its class, looked up by digest.
    linked = components(links.unionByName(repeated))
    clean_driver(spark)
    of_class = classes.join(linked, F.col("rep") == F.col("id"), "left").select("digest", "rep", "n_rows", F.coalesce("component", "rep").alias("component"))
    of_class = of_class.filter((F.col("n_rows") > 1) | (F.col("component") != F.col("rep"))).select(F.col("digest").alias("_class"), "component")
    # Rows without words have no class: their ids spread them.
    rows = sketched.select("doc_id", "n_shingles", F.coalesce("digest", F.unhex(F.hex("doc_id"))).alias("_key"))
    joined = rows.join(of_class, F.col("_key") == F.col("_class"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The members' rows with their sets: grp, id, degree, g_rows, g_shingles, shingles. Of an id with several texts, each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(words_of(t), width).tobytes() for t in utf8(b.column(5))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(found, pa.binary())], names=["grp", "id", "degree", "g_rows", "g_shingles", "shingles"])
        _words().clear()
        release_memory()

    wanted = members.select("grp", "id", "degree", "g_rows", "g_shingles")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id")).select("grp", "id", "degree", "g_rows", "g_shingles", "text")
    return texts.mapInArrow(run, "grp long, id long, degree long, g_rows long, g_shingles long, shingles binary")


_LINKS = "src long, dst long"


def _settle_small(sets: DataFrame, percent: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(settle(rows["id"].tolist(), _read(rows["shingles"]), rows["degree"].tolist(), percent), columns=["src", "dst"], dtype="int64")

    return sets.groupBy("grp").applyInPandas(run, _LINKS)


def _settle_large(sets: DataFrame, percent: int, group_rows: int, group_shingles: int) -> DataFrame:
    """Links of groups that don't fit one task: the hub against all, then what is left against all blocks.

    All joins are on the group; the side with a third of all rows is one that adaptive
    execution splits, the other is a written table of a row for each group or block.
    """
    best = F.max(F.struct("degree", F.negative("id").alias("i"), "shingles"))
    hub = cut_lineage(sets.groupBy("grp").agg(best.alias("best")).select("grp", F.col("best.shingles").alias("hub"), F.col("best.i").alias("i")), compact=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("shingles").to_pylist(), b.column("hub").to_pylist(), strict=True)
            hit = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), b.column("hub_id"), pa.array(hit, pa.bool_())], names=["grp", "id", "hub_id", "hit"])

    against = sets.join(hub, "grp").select("grp", "id", "shingles", "hub", F.negative("i").alias("hub_id"))
    settled = cut_lineage(against.mapInArrow(compare, "grp long, id long, hub_id long, hit boolean"))
    first = settled.filter("hit").select(F.col("hub_id").alias("src"), F.col("id").alias("dst"))

    hit_ids = settled.groupBy("grp", "id").agg(F.max("hit").alias("hit"))
    marked = sets.join(hit_ids, ["grp", "id"])
    n_blocks = F.greatest(F.ceil(F.col("g_rows") / (group_rows // 2)), F.ceil(F.col("g_shingles") / (group_shingles // 2))).cast("int")
    dealt = marked.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    # Pairs of blocks (left: rows the hub didn't settle; right: all rows). Only blocks that have such rows go left.
    lefts = cut_lineage(dealt.filter(~F.col("hit")).groupBy("grp", "nb").agg(F.collect_set("block").alias("left_blocks")), compact=True)
    right = dealt.join(lefts.select("grp", "left_blocks"), "grp").select("grp", F.explode("left_blocks").alias("l"), F.col("block").alias("r"), "id", "degree", "hit", "shingles", F.lit(False).alias("asks"))
    left = dealt.filter(~F.col("hit")).select("grp", F.col("block").alias("l"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("r"), "id", "degree", "hit", "shingles", F.lit(True).alias("asks"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows[rows["asks"]]
        others = rows[~rows["asks"]]
        ids, sets_ = others["id"].tolist(), _read(others["shingles"])
        u = _Union(len(ids) + 1)  # the last stands for all that the hub settled
        for j, hit in enumerate(others["hit"].tolist()):
            if hit:
                u.join(j, len(ids))
        links = []
        for one, own in zip(_read(asks["shingles"]), asks["id"].tolist(), strict=True):
            reached: set[int] = set()
            for j in _against(one, sets_, [j for j in range(len(ids)) if ids[j] != own], percent):
                if (root := u.find(j)) not in reached:
                    reached.add(root)
                    links.append((own, ids[j]))
        return pd.DataFrame(links, columns=["src", "dst"], dtype="int64")

    rest = left.unionByName(right).groupBy("grp", "l", "r").applyInPandas(run, _LINKS)
    return first.unionByName(rest)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group: the row whose id is the group's smallest. Other columns stay."""
    found = cut_lineage(near_duplicates(docs, width, percent))
    counts = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.max("kept").alias("_kept"))
    odd = cut_lineage(counts.filter((F.col("_rows") > 1) | ~F.col("_kept")).withColumnRenamed("doc_id", "_odd"))
    if odd.count() <= BROADCAST_ROWS:
        odd = F.broadcast(odd)
    joined = wrapped(docs).join(odd, F.col("_row.doc_id") == F.col("_odd"), "left")
    once = joined.filter(F.col("_odd").isNull())
    # Rows that repeat an id are one node of a group: one of them stays, the one of the smallest text.
    again = joined.filter(F.col("_kept") & (F.col("_rows") > 1))
    first = again.withColumn("_at", F.row_number().over(W.partitionBy("_row.doc_id").orderBy("_row.text"))).filter(F.col("_at") == 1).drop("_at")
    return unwrapped(once.unionByName(first), docs.columns)
