"""Spans of patterns in whole texts by built-in expressions only.

A span is (start, end, kind, value), in code points, end exclusive. Spark's own
functions return what a pattern matches but not where; here the text is split
at the matches too, and the lengths of the pieces add up to the places.

Every expression takes time in proportion to a text's length and matches, or a
little more: sums and maxima run by blocks, and nothing is appended to an array or
a text that grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_sql(values: str, op: str, depth: int = 2) -> str:
    """SQL of the running totals of an array of ints under `op`, an associative function of $x and $y.

    Beyond 64 values, blocks are totalled each, and the totals of the blocks the same way; with
    blocks of the cube root of the values no block has more than a few hundred.
    """
    put = lambda x, y: op.replace("$x", x).replace("$y", y)
    block = lambda a: f"aggregate({a}, CAST(array() AS array<int>), (t, y) -> concat(t, array(IF(size(t) = 0, y, {put('element_at(t, -1)', 'y')}))))"
    if not depth:
        return block(values)
    v, k, o = f"v{depth}", f"k{depth}", f"o{depth}"
    length = f"CAST(greatest(64, ceil(pow(size({v}), 1.0D / {depth + 1}))) AS INT)"
    return f"""transform(array({values}), {v} -> IF(size({v}) <= 64, {block(v)},
      transform(array(transform(sequence(1, size({v}), {length}), b -> {block(f"slice({v}, b, {length})")})), {k} ->
        transform(array({scan_sql(f"transform({k}, x -> element_at(x, -1))", op, depth - 1)}), {o} ->
          flatten(transform({k}, (x, i) -> IF(i = 0, x, transform(x, y -> {put(f'get({o}, i - 1)', 'y')})))))[0])[0]))[0]"""


_SUM, _MOST = "$x + $y", "greatest($x, $y)"


def find_sql(text: str, kind: int, pattern: str, valid: str = "true", value_group: int = 0, first: str | None = None) -> str:
    """SQL of all leftmost, non-overlapping matches of a Java pattern in the expression `text`.

    `valid` is SQL over $m (the match) and $v (its value group); matches that fail are dropped
    after they were matched. `first` is a cheap condition that every text with a match meets.
    """
    p = _quoted(pattern)
    met = f"regexp_like({text}, {p})" if first is None else f"({first}) AND regexp_like({text}, {p})"
    valid = valid.replace("$m", "x.m").replace("$v", "x.v")
    values = "transform(m, x -> named_struct('m', x, 'v', x))" if not value_group else f"zip_with(m, regexp_extract_all({text}, {p}, {value_group}), (x, v) -> named_struct('m', x, 'v', v))"
    ends = scan_sql(f"zip_with(slice(split({text}, {p}, -1), 1, size(m)), m, (g, x) -> length(g) + length(x))", _SUM)
    return f"""
      CASE WHEN {met} THEN
        transform(array(regexp_extract_all({text}, {p}, 0)), m ->
          filter(
            zip_with({values}, {ends}, (x, e) -> IF({valid}, named_struct('start', e - length(x.m), 'end', e, 'kind', {kind}, 'value', x.v), NULL)),
            s -> s IS NOT NULL))[0]
      ELSE CAST(array() AS {SPAN}) END"""


def find(text: str, kind: int, pattern: str, valid: str = "true", value_group: int = 0, first: str | None = None) -> Column:
    """find_sql as a Column."""
    return F.expr(find_sql(text, kind, pattern, valid, value_group, first))


def in_order(*found: Column) -> Column:
    """Spans of several kinds by start, then by kind."""
    return F.sort_array(F.expr(f"CAST(array() AS {SPAN})") if not found else F.concat(*found), True)


def listed(spans: str, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined; `spans` is a column sorted by (start, kind)."""
    kinds = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.end)), ',')")


def by_start_sql(spans: str) -> str:
    """SQL of the spans of a column sorted by start, then kind (the struct's own order would put the end first)."""
    return (
        f"transform(sort_array(transform({spans}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'value', s.value))), "
        "s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'value', s.value))"
    )


def by_start_then_kind(spans: str) -> Column:
    """by_start_sql as a Column."""
    return F.expr(by_start_sql(spans))


def apart_sql(spans: str, others: str) -> str:
    """SQL of the spans that no span of `others` overlaps; many of both are sorted and swept instead of paired."""
    ends = scan_sql("transform(x, e -> IF(e.own = 0, e.end, 0))", _MOST)
    starts = scan_sql("transform(reverse(x), e -> IF(e.own = 0, -e.start, -2147483647))", _MOST)
    return f"""
      transform(array(named_struct('a', {spans}, 'b', {others})), z ->
        CASE WHEN size(z.a) = 0 OR size(z.b) = 0 THEN z.a
        WHEN CAST(size(z.a) AS BIGINT) * size(z.b) <= 4096 THEN filter(z.a, s -> NOT exists(z.b, o -> o.start < s.end AND s.start < o.end))
        ELSE transform(array(sort_array(concat(
            transform(z.b, o -> named_struct('start', o.start, 'own', 0, 'end', o.end, 'kind', 0, 'value', CAST(NULL AS STRING))),
            transform(z.a, s -> named_struct('start', s.start, 'own', 1, 'end', s.end, 'kind', s.kind, 'value', s.value))))), x ->
          transform(
            filter(
              zip_with(zip_with(x, {ends}, (e, p) -> named_struct('e', e, 'p', p)), reverse({starts}), (y, n) -> named_struct('e', y.e, 'p', y.p, 'n', -n)),
              y -> y.e.own = 1 AND y.p <= y.e.start AND y.n >= y.e.end),
            y -> named_struct('start', y.e.start, 'end', y.e.end, 'kind', y.e.kind, 'value', y.e.value)))[0] END)[0]"""


def count(spans: str, kind: int) -> Column:
    return F.expr(f"CAST(size(filter({spans}, s -> s.kind = {kind})) AS BIGINT)")


_RUN = 256


def replaced(text: str, spans: str, names: list[str]) -> Column:
    """The text with each span, by start, put as <KIND>; of overlapping spans the first one's name stands for all.

    Spans are put by runs of 256, each in its own section of the text.
    """
    kinds = "array(" + ", ".join(f"'<{n.upper()}>'" for n in names) + ")"
    since = f"IF(b = 0, 0, get(r, CAST(b * {_RUN} - 1 AS INT)))"
    until = f"IF((b + 1) * {_RUN} >= size({spans}), length({text}), get(r, CAST((b + 1) * {_RUN} - 1 AS INT)))"
    return F.expr(f"""
      CASE WHEN size({spans}) = 0 THEN {text} ELSE
        transform(array({scan_sql(f"transform({spans}, s -> s.end)", _MOST)}), r ->
          array_join(transform(sequence(0, (size({spans}) - 1) div {_RUN}), b ->
            transform(array(named_struct('since', {since}, 'part', substring({text}, {since} + 1, {until} - {since}))), z ->
              aggregate(slice({spans}, CAST(b * {_RUN} + 1 AS INT), {_RUN}),
                named_struct('at', z.since, 'out', ''),
                (a, s) -> named_struct(
                  'at', greatest(a.at, s.end),
                  'out', IF(s.start >= a.at, concat(a.out, substring(z.part, a.at - z.since + 1, s.start - a.at), {kinds}[s.kind]), a.out)),
                a -> concat(a.out, substring(z.part, a.at - z.since + 1))))[0]), ''))[0] END""")


def with_replaced(joined: DataFrame, docs: DataFrame, text: str, spans: str, names: list[str]) -> DataFrame:
    """The rows of `joined` (_row, _text and a column of spans or null) with the columns of `docs`, the text replaced and its n_chars set anew."""
    done = joined.withColumn("_new", F.when(F.col(spans).isNotNull(), replaced("_text", spans, names)))
    out = []
    for c in docs.columns:
        own = F.col("_row")[c]
        if c == text:
            own = F.coalesce("_new", own)
        elif c == "n_chars":
            own = F.coalesce(F.length("_new").cast(docs.schema[c].dataType), own)
        out.append(own.alias(c))
    return done.select(*out)
