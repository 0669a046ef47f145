"""Secret scans judged by corpus-wide ownership frequency.

Candidates are found by pattern in every whole text. The digest of each
candidate's value is then counted over the corpus: in how many owners
(sources), and in how many repositories (distinct texts of an owner), it
stands. A value of many owners and repositories is an example that everybody
copies; one that few owners hold looks live. The patterns of the base always
give spans; opaque tokens, a wider pattern, give spans only if they look live.

The first pass writes one compact row for each document (places and digests,
no text) to the checkpoint folder, so texts are read once and never shuffled.
A value that a third of all rows holds is combined before each shuffle, and
the join that carries verdicts back is one that adaptive execution splits.

Defined cases: null texts are empty and have no spans; a null source is one
owner; repeated rows each get their own result and count as one repository;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import spans
from .common import wrapped

KINDS = ["assign", "access", "hex", "opaque"]
#: A value in at least so many owners and repositories is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 5, 20
#: Rows with live secrets up to which their spans are broadcast, with four spans a row in the mean.
BROADCAST_ROWS = 300_000

_ASSIGN = r"""(?=[pstaPSTA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Maximal runs: dropping runs that are too short and asking for the length give the same spans.
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
_OPAQUE_VALID = "regexp_count($m, '[0-9]') >= 4 AND regexp_like($m, '[a-z]') AND regexp_like($m, '[A-Z]')"


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repository and the spans of every candidate, per row of `docs`."""
    rows = docs.select("doc_id", F.col("source").alias("_owner"), F.coalesce("text", F.lit("")).alias("_text"))
    found = rows.select(
        "doc_id",
        "_owner",
        F.xxhash64("_text").alias("_repo"),
        spans.find("_text", 0, _ASSIGN, "length($v) >= 8", 1).alias("_assign"),
        spans.find("_text", 1, _ACCESS, first="contains(_text, 'AKIA')").alias("_access"),
        spans.find("_text", 2, _HEX).alias("_hex"),
        spans.find("_text", 3, _OPAQUE, _OPAQUE_VALID).alias("_opaque"),
    )
    based = found.select("doc_id", "_owner", "_repo", F.concat("_assign", "_access", "_hex").alias("_b"), "_opaque")
    apart = based.withColumn("_o", F.expr(spans.apart_sql("_opaque", "_b")))
    # Past this point a value is its digest.
    digest = "transform({}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'value', substring(sha2(s.value, 256), 1, 32)))"
    return apart.select("doc_id", "_owner", "_repo", F.expr(digest.format("concat(_b, _o)")).alias("_all"))


def ownership(candidates: DataFrame) -> DataFrame:
    """value -> owners, repositories: distinct owners, and distinct texts of each owner added up."""
    held = candidates.filter(F.size("_all") > 0).select(F.explode(F.expr("transform(_all, s -> s.value)")).alias("value"), "_owner", "_repo")
    texts = held.distinct()
    return texts.groupBy("value", "_owner").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, _repo, base and all spans sorted, and the numbers of example and live values, per row of `docs`.

    `_spans` has the base spans, and the opaque ones whose value looks live; `_live` has
    the spans of `_spans` whose value isn't a widely copied example.
    """
    compact = cut_lineage(_candidates(docs), partitions_per_file=8)
    examples = ownership(compact).filter((F.col("owners") >= example_owners) & (F.col("repositories") >= example_repositories)).select("value")
    held = compact.filter(F.size("_all") > 0).select("doc_id", "_repo", F.explode(F.expr("array_distinct(transform(_all, s -> s.value))")).alias("value"))
    copied = held.join(examples, "value").groupBy(F.col("doc_id").alias("_id"), F.col("_repo").alias("_r")).agg(F.collect_set("value").alias("_copied"))
    joined = compact.join(copied, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_repo") == F.col("_r")), "left")
    judged = joined.withColumn("_copied", F.coalesce("_copied", F.expr("CAST(array() AS array<string>)"))).withColumn(
        "_spans", F.expr("filter(_all, s -> s.kind < 3 OR NOT array_contains(_copied, s.value))")
    )
    return judged.select(
        "doc_id",
        "_repo",
        spans.by_start_then_kind("filter(_spans, s -> s.kind < 3)").alias("_base"),
        spans.by_start_then_kind("_spans").alias("_spans"),
        spans.by_start_then_kind("filter(_spans, s -> NOT array_contains(_copied, s.value))").alias("_live"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, all spans as text, and live and example counts, per row of `docs`."""
    return scan(docs).select(
        "doc_id",
        *[spans.count("_base", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(spans.listed("_base", KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.listed("_spans", KINDS).alias("spans"),
        F.size("_live").cast("long").alias("n_live"),
        (F.size("_spans") - F.size("_live")).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each live secret put as its kind's name; copied examples and all other text stay.

    `docs` is joined with the spans of the rows that have live secrets on (doc_id, digest of the
    text). They are broadcast up to BROADCAST_ROWS rows, so the texts aren't shuffled.
    """
    live = scan(docs).filter(F.size("_live") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("_repo").alias("_r")).agg(F.first("_live").alias("_live"))
    live = cut_lineage(live.withColumn("_live", F.expr("transform(_live, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))")), compact=True)
    size = live.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_live")), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= 4 * BROADCAST_ROWS:
        live = F.broadcast(live)
    own = wrapped(docs).withColumn("_text", F.col("_row")[text]).withColumn("_repo", F.xxhash64(F.coalesce("_text", F.lit(""))))
    joined = own.join(live, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_repo") == F.col("_r")), "left")
    return spans.with_replaced(joined, docs, text, "_live", KINDS)
