"""Operator 10: line-first cleaning with SQL functions only.

Every line is judged by itself: symbols or exclamation marks in place of punctuation, navigation rows, boilerplate
phrases, long runs of words without any sentence punctuation. Failing lines are removed; a document is rejected if
the removed lines hold too large a share of its words, or if it fails the base rules (too few words, or too many words
in repeated five-word windows).

A null text counts as empty: no words, which the base rules reject. A share at its limit passes. Repeated rows give repeated
results, an empty table an empty one; texts of any length are judged whole; columns other than doc_id and text are passed through by `clean` and ignored by `quality_rules`. Windows are hashed first and compared
as words only where hashes repeat, so equal hashes of different windows don't count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line with one of these is boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign in to",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
#: Parameters of the line rules and of the verdict, in percent or words.
MAX_SYMBOLS_PERCENT = 10
MAX_EXCLAIMED_PERCENT = 30
MIN_SEPARATORS = 3
MAX_WORDS_PER_SEPARATOR = 3
MIN_WORDS_UNPUNCTUATED = 30
MAX_LOST_PERCENT = 30
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACES), ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line of so many words fails a rule; lines without words never do."""
    chars = F.length(line)
    separators = _count(line, "|»›")
    symbols = _count(line, SYMBOLS) * 100 > chars * MAX_SYMBOLS_PERCENT
    exclaimed = (words >= 3) & (_count(line, "!") * 100 > words * 2 * MAX_EXCLAIMED_PERCENT)
    navigation = (separators >= MIN_SEPARATORS) & (words - separators <= (separators + 1) * MAX_WORDS_PER_SEPARATOR)
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    unpunctuated = (words >= MIN_WORDS_UNPUNCTUATED) & (_count(line, ".,;:!?…。") == 0)
    return (words > 0) & (symbols | exclaimed | navigation | boilerplate | unpunctuated)


def measure(docs: DataFrame) -> DataFrame:
    """All columns of docs but text as it was, with the base measures, n_lost, base_failed, kept and clean_text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = docs.columns
    # Each step is a projection of its own, so that arrays are built once.
    df = docs.select(*keep, F.array_remove(F.split(text, SPACES), "").alias("_words"), F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), _n_words(line).alias("n"))).alias("_lines"))
    df = df.select("*", F.size("_words").cast("long").alias("n_words"))
    w = F.col("_words")
    five = lambda i: [F.get(w, i + k) for k in range(5)]
    places = F.when(F.col("n_words") >= 6, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>"))
    df = df.select("*", F.transform(places, lambda i: F.xxhash64(*five(i))).alias("_hashes"))
    windows = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *five(i)).alias("w"), i.alias("i"))))
    df = df.select("*", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), windows).alias("_windows"))
    s = F.col("_windows")
    repeated = F.array_sort(
        F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + 5 - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + 5).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    judged = F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_fails(x["line"], x["n"]).alias("fails")))
    df = df.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), judged.alias("_judged"))
    df = df.select("*", F.transform(F.filter("_judged", lambda x: x["n"] > 0), lambda x: x["line"]).alias("_filled"))
    lost = F.aggregate("_judged", F.lit(0), lambda a, x: F.when(x["fails"], a + x["n"]).otherwise(a)).cast("long")
    good = F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"])
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    base_failed = (n < 10) | (repeats * 100 > n * 20)
    return df.select(
        *[c for c in keep],
        "n_words",
        F.length(F.translate(text, " \t\n\v\f\r", "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lost.alias("n_lost"),
        base_failed.alias("base_failed"),
        (~base_failed & (lost * 100 <= n * MAX_LOST_PERCENT)).alias("kept"),
        F.array_join(good, "\n").alias("clean_text"),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and n_lost (words in failing lines) for every row of docs (doc_id, text)."""
    measured = measure(docs.select("doc_id", "text"))
    return measured.select("doc_id", *MEASURES, "n_lost")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed; columns as in docs. The run's metrics have what was judged and kept."""
    measured = measure(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), "text"))
    # The counts of what was judged and kept are the run's metrics. No filter passes below them, so the steps of measure, which
    # build each array once, stay as they are.
    measured = measured.observe(f"quality_rules_{uuid.uuid4().hex}", F.count("*").alias("judged"), F.count_if("kept").alias("kept"), F.sum("n_lost").alias("lost_words")).where("kept")
    return measured.select(*[(F.col("clean_text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS lines, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
m AS (
  SELECT doc_id, t, len(w) AS n_words, w, lines,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled,
    list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) AS g
  FROM l),
r AS (
  SELECT doc_id, row_number() OVER () AS k, t, n_words, filled, g,
    list_transform(filled, lambda x: {
      'n': len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')),
      'c': length(x),
      'sym': length(x) - length(translate(x, '#*$%&|<>', '')),
      'sep': length(x) - length(translate(x, '|»›', '')),
      'ex': length(x) - length(replace(x, '!', '')),
      'p': length(x) - length(translate(x, '.,;:!?…。', '')),
      'b': regexp_matches(lower(x), 'all rights reserved|cookie policy|enable javascript|lorem ipsum|privacy policy|sign in to|skip to content|subscribe to our newsletter|terms of service|terms of use')}) AS f
  FROM m),
e AS (SELECT k, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM r),
c AS (SELECT *, count(*) OVER (PARTITION BY k, gram) AS n FROM e),
o AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM c WHERE n > 1),
s AS (SELECT k, sum(least(5, coalesce(i - before, 5))) AS rep FROM o GROUP BY k),
a AS (
  SELECT doc_id, n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(filled) - len(list_distinct(filled)) AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(f, lambda x: x.sym * 100 > x.c * 10 OR (x.n >= 3 AND x.ex * 100 > x.n * 60)
      OR (x.sep >= 3 AND x.n - x.sep <= (x.sep + 1) * 3) OR x.b OR (x.n >= 30 AND x.p = 0)), lambda x: x.n)), 0)::BIGINT AS n_lost
  FROM r LEFT JOIN s USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost,
  n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND n_lost * 100 <= n_words * 30 AS kept
FROM a
"""
