"""Quality rules, line first: judge each line, drop the failures, then reject texts that lose too much.

A line fails by one of these rules:

- punctuation: symbols are over 3% of its characters, there is an exclamation
  mark for each two words, or it has no closing punctuation and under three words;
- navigation: four or more cells between bars or arrows, or a menu's words only;
- boilerplate: a stock phrase, or a repetition of an earlier line of the text;
- shouting: over half of its letters are capitals, in ten letters or more.

A text is kept if it passes the base rules and at least half of its words stand
in lines that pass. All of it is built-in expressions of one row; nothing is
shuffled.

Defined cases: null and empty texts have no words and fail the base rules; words
are never cut, whatever the length of the text; repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Words of site menus, and stock phrases of web pages, in lower case.
MENU_WORDS = ["home", "menu", "next", "previous", "back", "login", "logout", "sign in", "sign up", "register", "search", "contact", "contact us", "about", "about us", "share", "tweet", "print", "help", "faq", "sitemap", "read more", "more", "top"]
STOCK_PHRASES = ["all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of use", "terms of service", "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "subscribe to our newsletter", "powered by"]

MAX_SYMBOL_PERCENT = 3
MIN_KEPT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Possessive, as a line may have any number of entries; longer entries come before those they begin with.
_MENU = r"(?i)^[\s|>»·•-]*+(?:(?:" + "|".join(sorted(MENU_WORDS, key=len, reverse=True)) + r")(?:[\s|>»·•-]++|$))++$"
_STOCK = "(?i)" + "|".join(STOCK_PHRASES)

#: Words of 5-word windows found twice or more: sort the windows' hashes with their places, keep
#: the places beside an equal hash, and count the words that the windows there cover.
_REPEATED = """
CASE WHEN size(_wins) > size(array_distinct(_wins)) THEN
  transform(array(sort_array(transform(_wins, (h, i) -> named_struct('h', h, 'i', i)))), s ->
    aggregate(
      array_sort(filter(transform(s, (x, j) -> IF((j > 0 AND get(s, j - 1).h = x.h) OR (j < size(s) - 1 AND get(s, j + 1).h = x.h), x.i, -1)), p -> p >= 0)),
      named_struct('n', 0L, 'last', -5),
      (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p),
      a -> a.n))[0]
ELSE 0L END"""

_WINDOWS = """
CASE WHEN n_words >= 5 THEN
  transform(sequence(0, size(_words) - 5), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2), get(_words, i + 3), get(_words, i + 4)))
ELSE array() END"""

#: What a failing line has is looked for in the whole text first (the flags), so texts without it, nearly all, skip the rule.
_FLAGS = {
    "_barred": "contains(_text, '|') OR contains(_text, '»') OR contains(_text, '→')",
    "_loud": "contains(_text, '!')",
    "_capital": "regexp_like(_text, '[A-Z]{2}')",
    "_stock": " OR ".join(f"contains(_lower, '{p}')" for p in STOCK_PHRASES),
}
_LINE_FAILS = f"""
  n_symbols > 0 AND length(l) - length(translate(l, '{SYMBOLS}', '')) > length(l) * {MAX_SYMBOL_PERCENT} / 100.0
  OR _loud AND l LIKE '%!%!%' AND 2 * (length(l) - length(translate(l, '!', ''))) > regexp_count(l, '{WORD}')
  OR instr('.!?:;…"”’»)', right(trim(TRAILING ' \t\r' FROM l), 1)) = 0 AND regexp_count(l, '{WORD}') < 3
  OR _barred AND length(l) - length(translate(l, '|»→', '')) >= 3
  OR regexp_like(l, r'{_MENU}')
  OR _stock AND regexp_like(l, '{_STOCK}')
  OR _capital AND regexp_like(l, '[A-Z]{{2}}') AND length(regexp_replace(l, '[^A-Z]+', '')) > 5 AND 2 * length(regexp_replace(l, '[^A-Z]+', '')) > length(regexp_replace(l, '[^A-Za-z]+', ''))
"""


def judge(docs: DataFrame, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """doc_id, the base counts, base_failed, n_lines, n_failed_lines, clean_words, clean_text and kept, per row of `docs`."""
    word = WORD.replace("\\", "\\\\")
    fails = _LINE_FAILS.replace(WORD, word)
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    counted = words.select(
        "doc_id",
        "_text",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(F.rlike("_text", F.lit("[#*$%&|<>]")), F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        F.lower("_text").alias("_lower"),
        F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("_lines"),
    )
    flags = {name: F.expr(sql) for name, sql in _FLAGS.items()}
    windows = counted.withColumn("_wins", F.expr(_WINDOWS)).withColumn("_unique", F.array_distinct("_lines")).withColumns(flags)
    judged = windows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size("_unique")).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
        F.expr(f"filter(_unique, l -> NOT coalesce({fails}, false))").alias("_clean"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    cleaned = judged.withColumn("clean_text", F.array_join("_clean", "\n")).withColumn("base_failed", failed)
    return cleaned.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_lines",
        (F.col("n_lines") - F.size("_clean")).alias("n_failed_lines"),
        F.regexp_count("clean_text", F.lit(WORD)).cast("long").alias("clean_words"),
        "clean_text",
    ).withColumn("kept", ~F.col("base_failed") & (100 * F.col("clean_words") >= min_kept_percent * F.col("n_words")))
