r"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Measures come from the words `[^\x20\x09-\x0D]+` and the \n-split lines of the whole text. Each rule is a measure with a
lower and an upper bound; the compiled verdict is the conjunction of all. Everything runs inside one scan, without
user functions or a shuffle. Repeated eight-word windows are found inside each document: equal 64-bit hashes
of windows mark their words (in a text of a million words two different windows are taken for equal with a chance of 3e-8).

The stop-word rule knows the languages of its list, by default English, French, German and Spanish; prose of others
has none of its words and fails, so give `judge` a list for the languages that the corpus has.

Defined cases: a null, empty or blank text has no words, so it fails the base rule and every ratio; very long texts are
measured whole; repeated rows, ids and nulls of doc_id come back as they are, a row each; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "on", "as", "at", "by", "this", "was", "are", "or", "an", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "en", "est", "pour", "dans", "sur", "avec", "qui", "il", "elle",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "für", "im", "ein", "eine", "nicht", "auf", "sich", "dem",
    "el", "los", "las", "del", "y", "se", "por", "con", "para", "una", "su", "al", "lo", "como", "es",
)


@dataclass(frozen=True)
class Rule:
    """A measure as an SQL expression over the columns of `measures`, and its bounds (None: none)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 24.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", 2.0, None),
    Rule("upper_share", "n_upper / word_chars", None, 0.4),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", None, 0.35),
    Rule("stutter_share", "n_stutters / n_words", None, 0.3),
    Rule("ellipsis_line_share", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_line_share", "n_bullet_lines / n_lines", None, 0.9),
)


def _repeated_words(words: str) -> str:
    """SQL: the number of words in windows that occur twice or more. Sorted hashes bring equal windows together."""
    w = REPEAT_WINDOW
    hashes = f"CASE WHEN size({words}) < {w} THEN array() ELSE transform(sequence(1, size({words}) - {w - 1}), i -> xxhash64(slice({words}, i, {w}))) END"
    equal = "coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false)"
    places = f"transform(filter(s, (x, i) -> {equal}), x -> x.p)"
    covered = f"aggregate(array_sort({places}), named_struct('n', 0, 'last', -{w}), (a, p) -> named_struct('n', a.n + least({w}, p - a.last), 'last', p), a -> a.n)"
    sorted_ = "array_sort(transform(hs, (h, p) -> named_struct('h', h, 'p', p)))"
    return f"element_at(transform(array({hashes}), hs -> CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0 ELSE element_at(transform(array({sorted_}), s -> {covered}), 1) END), 1)"


def measures(documents: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id and every count the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("words"),
        F.expr(r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    return parts.select(
        "doc_id",
        F.expr("cast(size(words) AS bigint)").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) AS bigint)").alias("word_chars"),
        F.expr("cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(f"cast({_repeated_words('words')} AS bigint)").alias("n_repeat_words"),
        F.expr("cast(size(lines) AS bigint)").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words))).cast("bigint").alias("n_stop_words"),
        F.expr("cast(size(filter(words, (w, i) -> w = get(words, i + 1))) AS bigint)").alias("n_stutters"),
        F.expr(r"cast(length(regexp_replace(text, '[^\\p{Lu}]+', '')) AS bigint)").alias("n_upper"),
        F.expr(r"cast(size(filter(lines, l -> l rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS bigint)").alias("n_ellipsis_lines"),
        F.expr(r"cast(size(filter(lines, l -> l rlike '^[\\x20\\x09-\\x0D]*[-*•]')) AS bigint)").alias("n_bullet_lines"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules' conjunction; a measure that is null fails."""
    return F.expr(verdict_sql(rules))


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    bounds = [f"({r.measure}) {sign} {bound}" for r in rules for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return f"coalesce({' AND '.join(bounds)}, false)"


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept: a row per row of documents."""
    guarded = tuple(Rule(r.name, r.measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ word_chars", "/ nullif(word_chars, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"), r.low, r.high) for r in rules)
    return measures(documents, stop_words).select("doc_id", *COLUMNS, F.expr(BASE_FAILED).alias("base_failed"), (F.expr(f"NOT ({BASE_FAILED})") & verdict(guarded)).alias("kept"))


#: DuckDB SQL of the query's rows.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
p AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, array_to_string(words[i : i + {REPEAT_WINDOW - 1}], chr(10)) AS w FROM (SELECT r, words, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) AS i FROM p WHERE len(words) >= {REPEAT_WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + {REPEAT_WINDOW})) AS k FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], lower(w)))) AS n_stop_words,
  len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutters,
  length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
  len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM p LEFT JOIN rep USING (r))
SELECT doc_id, {", ".join(COLUMNS)}, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND {verdict_sql()} AS kept FROM m
"""
