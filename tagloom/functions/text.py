"""Column functions over captions and other prose."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*(?![\p{L}\p{N}_])"
# Where sentences end, and quoted text.
BREAK = r"""[.!?]+(?:["')\]]+)?\s+"""
QUOTED = r'"[^"\n]*"|“[^”\n]*”'
# Markers of model formats and the headings that models put before an answer.
CONTROL = r"(?i)END_CAPTION|</?(?:think|ground_truth_tags|long_caption|format)>|<\|(?:im_start|im_end|endoftext|eot_id|start_header_id|end_header_id)\|>"
PREFIX = r"(?i)^\s*(?:#{1,6}\s*)?(?:(?:short|long|detailed)\s+)?(?:caption|description)\s*:\s*|^\s*here (?:is|are) (?:the|your|a) (?:(?:short|long|detailed)\s+)?captions?\s*:"


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    return F.split(c, BREAK)


def without_quotes(c: Column) -> Column:
    return F.regexp_replace(c, QUOTED, " ")


def longest_sentence(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(sentences(c), lambda s: F.size(words(s)))), F.lit(0))


def control_marker(c: Column) -> Column:
    """The first control marker; empty if there is none. Only texts with a bracket or the one word can have any."""
    may = F.contains(c, F.lit("<")) | F.contains(F.lower(c), F.lit("end_caption"))
    return F.when(~may, "").otherwise(F.regexp_extract(c, CONTROL, 0))


def response_prefix(c: Column) -> Column:
    return c.rlike(PREFIX)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    # One text at a time is a Python string. Arrow's own function gave others than this for 75 of 200 texts of the 0.001 table.
    out = pa.array((x if x is None else unicodedata.normalize("NFC", x) for x in (y.as_py() for y in s)), pa.string())
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def nfc(c: Column) -> Column:
    """Unicode NFC, for which there is no built-in function; texts of ASCII alone stay as they are and never leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


# Lines that frame a model's answer, and marks at the start of its lines.
FRAME = r"(?md)^\s*</?format>\s*$"
HEADING = r"(?imd)^\s*#+\s*(?:[12]\.\s*)?(?:Short|Long|Detailed) (?:description|caption)\s*:?\s*$"
MARK = r"(?md)^\s*>\s*"


def clean_output(c: Column, end: str = "END_CAPTION") -> Column:
    """NFC, up to the end marker; without frame and heading lines and the first `>` of every line; one line without outer quotes."""
    t = F.trim(F.substring_index(nfc(c), end, 1))
    for pattern in (FRAME, HEADING, MARK):
        t = F.regexp_replace(t, pattern, "")
    return F.trim(F.regexp_replace(one_line(t), '^"(.*)"$', "$1"))


@F.pandas_udf(StringType())
def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML character references, for which there is no built-in function; texts without an ampersand never leave the JVM."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def strip_reasoning(c: Column, tag: str = "think") -> Column:
    """Character references, escaped brackets and braces first; then without reasoning blocks (nested and unfinished ones too,
    and stray close tags) and without empty headings."""
    plain = F.translate(F.replace(F.replace(unescape(c), F.lit("\\<"), F.lit("<")), F.lit("\\>"), F.lit(">")), "{}", "")
    marks = rf"(?i)</?{tag}\s*>"

    def outside(t: Column) -> Column:
        parts = F.zip_with(F.split(t, marks, -1), F.concat(F.array(F.lit("")), F.regexp_extract_all(t, F.lit(marks), F.lit(0))), lambda text, mark: F.struct(text.alias("text"), mark.alias("mark")))
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            depth = F.when(x["mark"] == "", a["depth"]).when(F.startswith(x["mark"], F.lit("</")), F.greatest(F.lit(0), a["depth"] - 1)).otherwise(a["depth"] + 1)
            return F.struct(depth.alias("depth"), F.when(depth == 0, F.array_append(a["out"], x["text"])).otherwise(a["out"]).alias("out"))

        return F.array_join(F.aggregate(parts, start, step, lambda a: a["out"]), "")

    out = F.get(F.transform(F.array(plain), outside), F.lit(0))
    return F.regexp_replace(F.regexp_replace(out, r"(?md)^[ \t]*\\?#+[ \t]*\r?$", ""), r"^\s+|\s+$", "")


def replace_phrases(c: Column, table: list[tuple[str, str]]) -> Column:
    """Phrases replaced one after another, longest first, ties by text."""
    for old, new in sorted(table, key=lambda x: (-len(x[0]), x[0])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Lines that frame a report and are no part of it.
FRAME_LINES = (">", "# <format>", "<format>", "</format>")
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def clean_report(c: Column) -> Column:
    """Without braces and frame lines; `## # x` lines become `# x`; one quote goes off each end of the text."""
    edges = lambda x: F.regexp_replace(x, r"^[\s\x1C-\x1F\x85\p{Z}]+|[\s\x1C-\x1F\x85\p{Z}]+$", "")
    lines = F.filter(F.split(edges(F.translate(c, "{}", "")), LINE_BREAK), lambda x: ~edges(x).isin(*FRAME_LINES))
    mended = F.transform(lines, lambda x: F.when(F.startswith(edges(x), F.lit("## # ")), F.concat(F.lit("# "), F.substring(edges(x), F.lit(6), F.length(x)))).otherwise(x))
    return F.regexp_replace(F.regexp_replace(edges(F.array_join(mended, "\n")), r'^"', ""), r'"\z', "")


def _credits(artists: Column) -> Column:
    """The pattern of one or more credits at the start of a text: of the artists, alone or together, or of @ names."""
    names = F.filter(F.transform(artists, lambda a: F.regexp_replace(F.trim(a), "^@+", "")), lambda a: a != "")
    ats = F.transform(names, lambda a: F.concat(F.lit("@"), a))
    known = F.concat(names, ats, F.when(F.size(names) > 1, F.array(F.array_join(names, ", "), F.array_join(ats, ", "))).otherwise(F.array().cast("array<string>")))
    longest = F.array_sort(known, lambda a, b: F.length(b) - F.length(a))
    quoted = F.array_join(F.transform(longest, lambda a: F.concat(F.lit(r"\Q"), a, F.lit(r"\E|"))), "")
    # An @ name goes up to a comma or to a full stop before white space or the end.
    name = r"[^\S\r\n]*@(?!\s*(?:,|\.(?:\s|\z)))(?:(?!\.(?:\s|\z))[^,\r\n])+"
    return F.concat(F.lit(r"(?iu)^(?:\s*Drawn\s+by\s+(?:"), quoted, F.lit(rf"{name}(?:,{name})*)\.(?:\s+|\z))+"))


def strip_credit(c: Column, artists: Column | None = None) -> Column:
    """Without the credits (`Drawn by a, b. `) at the start: of @ names, and without @ only of the row's artists."""
    return F.regexp_replace(c, _credits(F.array().cast("array<string>") if artists is None else artists), F.lit(""))


def set_credit(c: Column, artists: Column) -> Column:
    """The credits at the start replaced by one of all artists, an array of names; as it is if there are none."""
    some = F.filter(artists, lambda a: F.trim(a) != "")
    names = F.transform(some, lambda a: F.when(F.startswith(a, F.lit("@")), a).otherwise(F.concat(F.lit("@"), a)))
    return F.when(F.size(some) > 0, F.concat(F.lit("Drawn by "), F.array_join(names, ", "), F.lit(". "), strip_credit(c, artists))).otherwise(c)


# Headings of what a description leaves out; the first that a text has counts.
CUTS = ("h4. costumes", "h4. appearance")


def clean_wiki(c: Column, cuts: tuple[str, ...] = CUTS) -> Column:
    """Cut at a heading; links become their text; other brackets and `!` lines go; white space collapses."""
    kept = c
    for cut in reversed(cuts):
        at = F.instr(F.lower(c), cut)
        kept = F.when(at > 0, F.left(c, at - 1)).otherwise(kept)
    kept = F.regexp_replace(kept, r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1")
    kept = F.regexp_replace(kept, r"\[\[([^\]]+)\]\]", "$1")
    return one_line(F.regexp_replace(F.regexp_replace(kept, r"\[[^\]]*\]", ""), r"(?md)^!.*$", ""))


def clean_reference(c: Column) -> Column:
    """What stands before the word h4 or h5 or a voice credit, on one line."""
    return one_line(F.get(F.split(c, r"(?iU)\bh[45]\b|voiced by"), F.lit(0)))


def accept_description(c: Column, banned: list[str]) -> Column:
    t = F.trim(c)
    bad = F.lit(False)
    for b in banned:
        bad = bad | F.contains(F.lower(t), F.lit(b))
    return F.coalesce((t != "") & ~F.contains(t, F.lit("\n")) & (F.size(F.split(t, r"\s+")) <= 100) & ~bad, F.lit(False))


def empty_reasoning_loop(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?i)<think>\s*</think>"), F.lit(0))) >= 3
