"""Personal data, and the terms around it that would give it away.

The base finds addresses, numbers and hosts by pattern: they are the protected
entities. Sanitisation then asks the corpus which terms reveal an entity: for a
term t of a document that holds the entity e, with counts n(t), n(e), n(t, e)
of N documents, the disclosure is

    log(n(t, e) N / (n(t) n(e))) / log(N / n(e)),

the pointwise mutual information as a share of all there is to learn about e: 1
if t only stands where e is. Terms at DISCLOSURE or more, seen with e in at
least SUPPORT distinct texts, become spans too, wherever they stand in a text
that holds e, and are put as <TERM>. A term is a run of letters, marks and
digits of any length that no base span touches.

One pass finds the base spans. Only entities that SUPPORT texts hold can have
such terms, so only texts that hold one of these are read again for their terms.
n(t) takes a pass over all texts, for the terms that SUPPORT of those texts
have; terms too frequent for any entity (a bound that follows from n(t, e) <=
n(e)) are dropped before terms and entities are paired. Tables for these passes
are broadcast if they have at most BROADCAST_TERMS rows; beyond that the words
are counted before they are shuffled and joined.

Defined cases: null texts are empty and have no spans; repeated rows each get
their own result, and count as one text towards SUPPORT; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import spans
from .common import wrapped

KINDS = ["email", "ip", "card", "phone", "term"]
#: Share of what there is to learn about an entity from which a term is sanitised.
DISCLOSURE = 0.9
#: Distinct texts that must have the term beside the entity.
SUPPORT = 2
#: Terms up to which their table is broadcast: 16 bytes each.
BROADCAST_TERMS = 2_000_000

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"[\p{L}\p{M}\p{N}]++"
_IP_VALID = "forall(split($m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', substring(ltrim('0', p), 1, 3)) AS INT) <= 255)"
_DIGITS = "regexp_replace($m, '[^0-9]', '')"
_LUHN = f"""length({_DIGITS}) BETWEEN 14 AND 19 AND aggregate(
  transform(split(reverse({_DIGITS}), ''), (c, i) -> IF(i % 2 = 0, int(c), IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))), 0, (s, d) -> s + d) % 10 = 0"""


def _based(rows: DataFrame) -> DataFrame:
    """`rows` (with _text) and the base spans _b."""
    own = rows.columns
    found = rows.select(
        *own,
        spans.find("_text", 0, _EMAIL, first="contains(_text, '@')").alias("_email"),
        spans.find("_text", 1, _IP, _IP_VALID).alias("_ip"),
        spans.find("_text", 2, _CARD, _LUHN).alias("_card"),
        spans.find("_text", 3, _PHONE, f"length({_DIGITS}) BETWEEN 10 AND 15", first="contains(_text, '+')").alias("_phone"),
    )
    return found.select(*own, F.concat("_email", "_ip", "_card", "_phone").alias("_b"))


def _mentions(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text and base spans, with the entity's hash as value, per row."""
    based = _based(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")))
    return based.select(
        "doc_id",
        F.xxhash64("_text").alias("_repo"),
        F.expr("transform(_b, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'value', CAST(xxhash64(s.kind, lower(s.value)) AS STRING)))").alias("_b"),
    )


def _terms(text: str) -> str:
    """SQL of the hashes of the distinct terms of a text, wherever they stand."""
    return f"array_distinct(transform(regexp_extract_all({text}, {spans._quoted(_TERM)}, 0), w -> xxhash64(lower(w))))"


def _outside(rows: DataFrame, valid: str = "true") -> DataFrame:
    """`rows` (with _text) and, as _t, the spans of the terms that no base span touches."""
    found = _based(rows).select(*rows.columns, "_b", F.expr(spans.find_sql("_text", 4, _TERM, valid)).alias("_t"))
    return found.select(*rows.columns, F.expr(spans.apart_sql("_t", "_b")).alias("_t"))


def _semi(rows: DataFrame, wanted: DataFrame, key: str, most: int) -> DataFrame:
    """The rows whose key is in `wanted`, which is broadcast if it has `most` rows at most."""
    return rows.join(F.broadcast(wanted) if wanted.limit(most + 1).count() <= most else wanted, key, "left_semi")


def _term_counts(docs: DataFrame, wanted: DataFrame, broadcast_terms: int) -> DataFrame:
    """term -> n_t, the documents that have the wanted terms anywhere in their text."""
    words = docs.select(F.explode(F.expr(_terms("_text"))).alias("term"))
    if wanted.count() <= broadcast_terms:
        return words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term", "left_semi")


def _counted(rows: DataFrame, keys: list[str], name: str, support: int) -> DataFrame:
    """keys -> number of rows, for keys that at least `support` distinct texts have; combined before each shuffle."""
    texts = rows.groupBy(*keys, "_repo").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias(name), F.count(F.lit(1)).alias("_texts"))
    return texts.filter(F.col("_texts") >= support).drop("_texts")


def _classes(rows: DataFrame, key: str, count: str) -> DataFrame:
    """key -> _class: the same for keys that stand in the same texts and count the same; by two 64-bit sums of the texts' hashes, which need no list of them."""
    seal = lambda k: F.bit_xor(F.xxhash64("_repo", F.lit(k)))
    return rows.groupBy(key, count).agg(seal(1).alias("_s1"), seal(2).alias("_s2")).select(key, F.xxhash64(count, "_s1", "_s2").alias("_class"))


def disclosing(docs: DataFrame, mentions: DataFrame, disclosure: float, support: int, broadcast_terms: int) -> DataFrame | None:
    """(_repo, term) of the terms that give an entity of a text away, by text; None if no entity has the support.

    docs: doc_id, _repo and _text.
    """
    n = float(max(mentions.count(), 1))
    seen = mentions.filter(F.size("_b") > 0)
    entities = seen.select("_repo", F.explode(F.expr("array_distinct(transform(_b, s -> CAST(s.value AS BIGINT)))")).alias("entity"))
    n_e = cut_lineage(_counted(entities, ["entity"], "n_e", support), compact=True)
    if not n_e.limit(1).count():
        return None
    held = cut_lineage(entities.distinct().join(n_e, "entity"), compact=True)
    opened = _outside(_semi(docs.select("_repo", "_text"), held.select("_repo").distinct(), "_repo", broadcast_terms))
    # _n rows have the same text; they are one row from here on.
    terms = cut_lineage(opened.select("_repo", F.explode(F.expr("array_distinct(transform(_t, s -> xxhash64(lower(s.value))))")).alias("term")).groupBy("_repo", "term").agg(F.count(F.lit(1)).alias("_n")), compact=True)
    wanted = cut_lineage(terms.groupBy("term").agg(F.count(F.lit(1)).alias("_texts")).filter(F.col("_texts") >= support).select("term"), compact=True)
    # disclosure >= d means n_t <= n_te (N / n_e)^(1 - d), and n_te is n_e at most.
    most = F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(max(0.0, 1 - disclosure))) * (1 + 1e-6)
    bound = n_e.agg(F.max(most)).first()[0]
    counts = cut_lineage(_term_counts(docs.select("_text"), wanted, broadcast_terms).filter(F.col("n_t") <= bound), compact=True)
    # Entities of the same texts are one class, and terms of the same texts: a list of many names in few texts is one pair of classes, not all pairs.
    entity_class = cut_lineage(_classes(held, "entity", "n_e"), compact=True)
    entities = cut_lineage(held.join(entity_class, "entity").select("_repo", F.col("_class").alias("entities"), "n_e").distinct(), compact=True)
    counted = terms.join(counts, "term")
    term_class = cut_lineage(_classes(counted, "term", "n_t"), compact=True)
    classes = cut_lineage(counted.join(term_class, "term").select("_repo", F.col("_class").alias("terms"), "n_t", "_n").distinct(), compact=True)
    pairs = classes.join(entities, "_repo").filter(F.col("n_t") <= most)
    both = pairs.groupBy("entities", "terms").agg(F.sum("_n").alias("n_te"), F.count(F.lit(1)).alias("_texts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).filter(F.col("_texts") >= support)
    learned = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.log(n / F.col("n_e")), F.lit(1e-9))
    given = both.filter(learned >= disclosure).select("entities", "terms")
    told = cut_lineage(classes.join(given, "terms").join(entities, ["_repo", "entities"], "left_semi").select("_repo", "terms").distinct(), compact=True)
    return cut_lineage(terms.select("_repo", "term").join(term_class.select("term", F.col("_class").alias("terms")), "term").join(told, ["_repo", "terms"], "left_semi").select("_repo", "term"), compact=True)


def scan(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, _repo, the base spans and all spans, sorted, per row of `docs`."""
    mentions = cut_lineage(_mentions(docs), partitions_per_file=8)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_repo", F.xxhash64("_text"))
    given_away = disclosing(texts, mentions, disclosure, support, broadcast_terms)
    base = spans.by_start_then_kind("_b").alias("_base")
    if given_away is None:
        return mentions.select("doc_id", "_repo", base, spans.by_start_then_kind("_b").alias("_spans"))
    # The terms of a text in one row; each of their occurrences outside base spans is a span.
    told = given_away.groupBy("_repo").agg(F.collect_set("term").alias("_given"))
    told = F.broadcast(told) if given_away.limit(broadcast_terms + 1).count() <= broadcast_terms else told
    places = F.expr("transform(_t, t -> named_struct('start', t.start, 'end', t.end, 'kind', t.kind, 'value', ''))")
    found = _outside(texts.join(told, "_repo"), "array_contains(_given, xxhash64(lower($m)))").select(F.col("doc_id").alias("_id"), F.col("_repo").alias("_r"), places.alias("_t"))
    found = found.groupBy("_id", "_r").agg(F.first("_t").alias("_t"))  # repeated rows
    joined = mentions.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_repo") == F.col("_r")), "left")
    return joined.select(
        "doc_id",
        "_repo",
        base,
        spans.by_start_then_kind(f"concat(_b, coalesce(_t, CAST(array() AS {spans.SPAN})))").alias("_spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, per row of `docs`."""
    return scan(docs).select(
        "doc_id",
        *[spans.count("_base", k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(spans.listed("_base", KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.listed("_spans", KINDS).alias("spans"),
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span put as its kind's name."""
    found = scan(docs).filter(F.size("_spans") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("_repo").alias("_r")).agg(F.first("_spans").alias("_spans"))
    own = wrapped(docs).withColumn("_text", F.col("_row")[text]).withColumn("_repo", F.xxhash64(F.coalesce("_text", F.lit(""))))
    joined = own.join(found, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_repo") == F.col("_r")), "left")
    return spans.with_replaced(joined, docs, text, "_spans", KINDS)
