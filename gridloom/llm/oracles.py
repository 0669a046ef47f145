"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / greatest(coalesce(pow(length(translate(text, '#*$%&|<>{}\^~0123456789', ''))::DOUBLE / nullif(length(text), 0), 2), 0.0001), 0.0001) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((i - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, cap / w AS fl FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fl, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY fl, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f),
p AS (SELECT lev FROM l WHERE lev <= fl ORDER BY fl, i LIMIT 1),
t AS (SELECT f.source, source_size, least(cap, coalesce((SELECT lev FROM p) * w, cap)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
g AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM d)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - prior)))::BIGINT AS taken
FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
"""


def _licences() -> str:
    """The lookup of licence digests: the same canonical form, by DuckDB's functions."""
    from .licences import KNOWN, MARKERS, SPELLINGS

    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        x = rf"regexp_replace(lower({x}), '(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$|all rights reserved', ' ', 'g')"
        x = rf"' ' || trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
        for spelled, as_ in SPELLINGS:
            x = f"replace({x}, {quoted(f' {spelled} ')}, {quoted(f' {as_} ')})"
        return f"md5(trim({x}))"

    marked = lambda x: "(" + " OR ".join(f"contains(lower({x}), {quoted(m)})" for m in MARKERS) + ")"
    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT licence, {canonical('t')} AS digest FROM (VALUES {known}) k(licence, t)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, true AS whole, {canonical('text')} AS digest FROM d WHERE {marked('text')}
      UNION ALL
      SELECT r, false, {canonical('l')} FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d WHERE {marked('text')}) WHERE {marked('l')}),
h AS (SELECT r, max(CASE WHEN whole THEN licence END) AS whole_text, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, sum(CASE WHEN whole THEN 0 ELSE 1 END) AS n FROM u JOIN known USING (digest) GROUP BY r)
SELECT doc_id, whole_text, coalesce(licences, '') AS licences, coalesce(n, 0)::BIGINT AS n_notices FROM d LEFT JOIN h USING (r)
"""


SQL["op9_licences"] = _licences()


def _quality() -> str:
    """Base counts by exploded windows, and the line rules, each tried on each line."""
    from .quality import MAX_SYMBOL_PERCENT, MENU_WORDS, MIN_KEPT_PERCENT, STOCK_PHRASES, SYMBOLS

    word = r"'[^\x20\x09-\x0D]+'"
    count = lambda x: f"len(regexp_extract_all({x}, {word}))"
    menu = r"(?i)^[\s|>»·•-]*(?:(?:" + "|".join(MENU_WORDS) + r")(?:[\s|>»·•-]+|$))+$"
    fails = f"""
      length(l) - length(translate(l, '{SYMBOLS}', '')) > length(l) * {MAX_SYMBOL_PERCENT} / 100.0
      OR l LIKE '%!%!%' AND 2 * (length(l) - length(translate(l, '!', ''))) > {count('l')}
      OR NOT regexp_matches(l, '[.!?:;…"”’»)][ \\t\\r]*$') AND {count('l')} < 3
      OR length(l) - length(translate(l, '|»→', '')) >= 3
      OR regexp_matches(l, '{menu}')
      OR regexp_matches(l, '(?i){"|".join(STOCK_PHRASES)}')
      OR regexp_matches(l, '[A-Z][A-Z]') AND length(regexp_replace(l, '[^A-Z]+', '', 'g')) > 5 AND 2 * length(regexp_replace(l, '[^A-Z]+', '', 'g')) > length(regexp_replace(l, '[^A-Za-z]+', '', 'g'))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
full_lines AS (SELECT r, l FROM lines WHERE regexp_matches(l, {word})),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM full_lines GROUP BY r),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
seen AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i + 4]) AS n FROM win),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM seen, range(5) x(k) WHERE n > 1 GROUP BY r),
clean AS (SELECT r, sum({count('l')}) AS n FROM (SELECT DISTINCT r, l FROM full_lines) WHERE NOT ({fails}) GROUP BY r),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(clean.n, 0) AS clean
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN clean USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * clean >= {MIN_KEPT_PERCENT} * n_words AS kept FROM j
"""


SQL["op10_quality_rules"] = _quality()


def _secrets() -> str:
    """Spans from the pieces between matches, as positions add up; ownership over the values' digests."""
    from .secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES

    patterns = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, "length(v) >= 8"),
        ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
        ("hex", "[0-9a-f]+", 0, "length(v) >= 32"),
        ("opaque", "[A-Za-z0-9+/_-]+", 0, "length(v) >= 24 AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"),
    ]
    parts = []
    for k, (_, pattern, group, valid) in enumerate(patterns):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT r, {k} AS k, s, e, v FROM (
              SELECT r, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e, v
              FROM (SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
                    FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs FROM d))) WHERE {valid}"""
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
a AS (SELECT * FROM f WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.k < 3 AND b.r = f.r AND b.s < f.e AND f.s < b.e)),
o AS (SELECT v, count(*) AS owners, sum(n) AS repos FROM (SELECT v, source, count(DISTINCT t) AS n FROM a JOIN d USING (r) GROUP BY v, source) GROUP BY v),
j AS (SELECT a.*, owners >= {EXAMPLE_OWNERS} AND repos >= {EXAMPLE_REPOSITORIES} AS example FROM a JOIN o USING (v)),
x AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][k + 1] || ':' || s || ':' || e AS txt FROM j WHERE k < 3 OR NOT example),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(txt, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(txt, ',' ORDER BY s, k) AS spans, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""


SQL["op4_secrets"] = _secrets()
