"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / w, with u uniform and fixed by
its id and w its quality weight. Sorted by that key within its source, a prefix
of the documents is a weighted sample without replacement; the prefix ends
where the source's word budget does. Budgets above the source's size take
complete epochs first, and only the rest is sampled.

No source is ever sorted. One pass over the texts leaves a compact row of each
document (key and words). Words are summed by source and range of the key's
logarithm, which shows the range in which each source's budget ends; ranges of
over RANGE_ROWS documents are split again, and only documents of the last range
are put in order. How often a document is taken then depends on its own key and
on one row for its source, so the mix is a narrow pass.

Defined cases: a null text has size 0 and takes nothing; null is a source of
its own, ordered last; rows that repeat a document (the same key, id and size)
share what the budget leaves for them evenly, to the word; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, unwrapped

#: Ranges of a source's keys: so many for each power of e, and where one is split again.
PER_E, SPLIT = 256, 4096
#: Documents of a source that are put in order in one task.
RANGE_ROWS = 200_000
WEIGHTS, TOTAL, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix"
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
#: Characters that count against a document's quality.
JUNK = r"#*$%&|<>{}\\^~0123456789"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Square of the share of characters that aren't symbols or digits; null without characters."""
    clean = F.try_divide(F.length(text) - F.regexp_count(text, F.lit(f"[{JUNK}]")), F.length(text))
    return clean * clean


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), fixed by the id and the seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` sorted: _p numbers the parts of a global sort, _m the rows (with gaps); both rise with the order."""
    return cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))


def _before(df: DataFrame, *names: str) -> DataFrame:
    """With _<name>: the sum of a column over all rows before, by part first, so no task sees more than a part."""
    parts = df.groupBy("_p").agg(*[F.sum(c).alias(c) for c in names])
    starts = parts.select("_p", *[F.coalesce(F.sum(c).over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}") for c in names])
    within = W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)
    own = df.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_own_{c}") for c in names])
    joined = own.join(starts, "_p")
    return joined.select(*df.columns, *[(F.col(f"_{c}") + F.col(f"_own_{c}")).alias(f"_{c}") for c in names])


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float, few: bool = False) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, have `weights` in turn and share `total` times all
    sizes; no target exceeds `most` times its source's size, what is above goes to the
    others by weight. That ends at one level l: target = min(most * size, l * weight),
    found here by sorting sources by the level at which they fill up. `few` sources (a
    checked number) are put in order in one task, others by a distributed sort.
    """
    weight = lambda i: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * F.lit(float(most))).alias("cap")
    by_source, by_level = F.col("source").asc_nulls_last(), (F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    if few:
        rank = F.row_number().over(W.orderBy(by_source)) - 1
        order = W.orderBy(*by_level).rowsBetween(W.unboundedPreceding, -1)
        full = sizes.select("source", "source_size", weight(rank).alias("w"), cap)
        before = full.select("*", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"_{c}") for c in ("cap", "w")], F.row_number().over(W.orderBy(*by_level)).alias("_m"))
    else:
        numbered = _before(_in_order(sizes.withColumn("one", F.lit(1)), by_source), "one")
        before = _before(_in_order(numbered.select("source", "source_size", weight(F.col("_one")).alias("w"), cap), *by_level), "cap", "w")
    before = before.withColumn("_one_row", F.lit(1))
    whole = before.groupBy("_one_row").agg(F.sum("source_size").alias("_s"), F.sum("w").alias("_all"))
    leveled = before.join(F.broadcast(whole), "_one_row").withColumn("_l", (F.col("_s") * F.lit(float(total)) - F.col("_cap")) / (F.col("_all") - F.col("_w")))
    # The level is that of the first source that isn't full at the level of those before it.
    level = leveled.filter(F.col("_l") <= F.col("cap") / F.col("w")).groupBy("_one_row").agg(F.min_by("_l", "_m").alias("_level"))
    return before.join(F.broadcast(level), "_one_row", "left").select("source", "source_size", F.least("cap", F.coalesce(F.col("_level") * F.col("w"), F.col("cap"))).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / w; a weight that is null or under 0.0001 is taken as that."""
    return -F.log(uniform(doc_id, seed)) / F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0001)), F.lit(0.0001))


def _key(weight: Column | None, seed: str) -> Column:
    return sampling_key(F.col("doc_id"), quality_weight(F.col("text")) if weight is None else weight, seed)


def _rows(docs: DataFrame, weight: Column | None, seed: str) -> DataFrame:
    """The compact row of each document: all that is read more than once."""
    return cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key(weight, seed).alias("key")), partitions_per_file=8)


def _bounded(df: DataFrame) -> tuple[DataFrame, list | None]:
    """One row a source: broadcast up to BROADCAST_SOURCES of them, and these rows; None where there are more."""
    found = df.limit(BROADCAST_SOURCES + 1).collect()
    if len(found) > BROADCAST_SOURCES:
        return cut_lineage(df), None
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)), found


def _of_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _ending(ranges: DataFrame, sources: DataFrame) -> DataFrame:
    """The range (source, range, n, m, lo, hi) in which the budget of its source ends, and the words before it."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = _of_source(ranges.withColumn("_w", before), sources).withColumn("start", F.col("start") + F.col("_w"))
    return found.filter((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("n")))


def _summed(rows: DataFrame) -> DataFrame:
    """(source, key, range, size) by source and range: words n, rows m, least and greatest key."""
    return rows.groupBy("source", "range").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def _budgets(rows: DataFrame, weights: tuple[float, ...], total: float, most: float, range_rows: int) -> DataFrame:
    """Per source (_s): source_size, target, epochs and the end of its sample. rows: doc_id, source, size and key.

    last is the key, id and size of the document in which the budget ends (null if nothing is sampled), left
    the words the budget has for it and equal the number of rows that are just like it.
    """
    ranges = _summed(rows.withColumn("range", F.floor(F.log("key") * PER_E)))
    sizes, few = _bounded(ranges.groupBy("source").agg(F.sum("n").alias("source_size")))
    targets = source_targets(sizes, weights, total, most, few is not None)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    budgets, _ = _bounded(budgets.withColumnRenamed("source", "_s"))
    kept = [F.col("source").alias("_s"), "start", "rest", "m", "lo", "hi"]
    now, found = _bounded(_ending(ranges, budgets.select("_s", "rest", F.lit(0).cast("long").alias("start"))).select(*kept))
    while any(r["m"] > range_rows and r["lo"] < r["hi"] for r in (now.filter((F.col("m") > range_rows) & (F.col("lo") < F.col("hi"))).limit(1).collect() if found is None else found)):
        within = _of_source(rows, now).filter(F.col("key").between(F.col("lo"), F.col("hi")))
        part = F.when(F.col("lo") < F.col("hi"), F.width_bucket("key", F.col("lo"), F.col("hi"), F.lit(SPLIT))).otherwise(0).alias("range")
        now, found = _bounded(_ending(_summed(within.select("source", "key", "size", part)), now.select("_s", "rest", "start")).select(*kept))
    within = _of_source(rows, now).filter(F.col("key").between(F.col("lo"), F.col("hi")))
    alike = within.select("source", "start", "rest", F.struct("key", "doc_id", "size").alias("last")).groupBy("source", "last").agg(F.count(F.lit(1)).alias("equal"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    own = F.col("equal") * F.col("last.size")
    before = F.coalesce(F.sum(own).over(W.partitionBy("source").orderBy("last").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = alike.withColumn("left", F.col("rest") - F.col("start") - before).filter((F.col("left") > 0) & (F.col("left") <= own))
    joined = budgets.join(last.select(F.col("source").alias("_t"), "last", "left", "equal"), F.col("_s").eqNullSafe(F.col("_t")), "left")
    return _bounded(joined.select("_s", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "last", "left", "equal"))[0]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = SEED, weight: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken and sampling_key, per row of `docs`; `weight` is a document's quality."""
    rows = _rows(docs, weight, seed)
    budgets = _budgets(rows, weights, total, most, range_rows)
    own = F.struct("key", "doc_id", "size")
    sampled = F.when(own < F.col("last"), F.col("size")).when(own == F.col("last"), F.floor(F.col("left") / F.col("equal"))).otherwise(0)
    sized = _of_source(rows, budgets)
    taken = (F.col("epochs") * F.col("size") + F.coalesce(sampled, F.lit(0))).cast("long").alias("taken")
    return sized.select("doc_id", "source", "size", "source_size", "target", "epochs", taken, F.col("key").alias("sampling_key"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = SEED, weight: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as the mix takes it, whole.

    The document in which its source's budget ends is taken if half of it or more is.
    """
    budgets = _budgets(_rows(docs, weight, seed), weights, total, most, range_rows)
    own = F.struct(_key(weight, seed).alias("key"), "doc_id", n_words(F.col("text")).alias("size")).alias("_own")
    joined = _of_source(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "source", own), budgets)
    half = 2 * F.col("left") >= F.col("equal") * F.col("last.size")
    copies = F.col("epochs") + F.coalesce((F.col("_own") < F.col("last")) | ((F.col("_own") == F.col("last")) & half), F.lit(False)).cast("int")
    repeated = joined.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return unwrapped(repeated, docs.columns)
