"""Column functions over tags and record fields: normalisation, parsing, labels.

All are built-in expressions. A null input gives null unless stated; lists never hold blanks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(r"\("), F.lit("(")), F.lit(r"\)"), F.lit(")"))


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def normalize_tag(c: Column, profile: str = "clean") -> Column:
    """One tag in the form that a profile compares or puts out.

    clean: unescape, underscores to spaces, collapse, lower. output: as clean, but case and escapes stay. stats and cache:
    trim, lower, unescape, underscores to spaces, collapse, without a last trim. prompt: as stats without unescaping.
    terms and character: lower, underscores to spaces, collapse. compare: trim, unescape, lower, spaces to underscores.
    """
    if profile == "clean":
        return F.lower(_collapse(_spaced(_unescape(c))))
    if profile == "output":
        return _collapse(_spaced(c))
    if profile in ("stats", "cache"):
        return F.regexp_replace(_spaced(_unescape(F.lower(strip(c)))), r"\s+", " ")
    if profile == "prompt":
        return F.regexp_replace(_spaced(F.lower(strip(c))), r"\s+", " ")
    if profile in ("terms", "character"):
        return _collapse(_spaced(F.lower(c)))
    if profile == "compare":
        return F.replace(F.lower(_unescape(strip(c))), F.lit(" "), F.lit("_"))
    raise ValueError(f"unknown profile {profile}")


def normalize_header(name: str) -> str:
    return " ".join(name.strip().lower().replace("_", " ").split())


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename all columns to their normal form; of columns that fall together the last stays."""
    last = {normalize_header(c): i for i, c in enumerate(df.columns)}
    return df.select(*[df[df.columns[i]].alias(n) for n, i in sorted(last.items(), key=lambda x: x[1])])


def get_column(df: DataFrame, *aliases: str) -> Column:
    """The first alias that exists and is not null, trimmed, even if empty; else the empty string."""
    have = {normalize_header(c): c for c in df.columns}
    found = [F.trim(df[have[normalize_header(a)]].cast("string")) for a in aliases if normalize_header(a) in have]
    return F.coalesce(*found, F.lit(""))


def _filled(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def parse_tags(c: Column) -> Column:
    """Comma tags in clean form, first occurrences, no blanks; null and empty give an empty list."""
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(", ,"), F.lit(",")), ",")
    return F.array_distinct(_filled(F.transform(parts, lambda x: normalize_tag(x))))


def split_tags(c: Column) -> Column:
    """Comma tags in output form, repeats kept."""
    return _filled(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: normalize_tag(x, "output")))


def split_or_single(c: Column) -> Column:
    """As split_tags; a text without a comma is one tag."""
    return split_tags(c)


def split_meta(c: Column) -> Column:
    """By comma; else by space if there are both an underscore and an inner space; else one tag."""

    def split(t: Column) -> Column:
        words = _filled(F.transform(F.split(t, r"\s+"), lambda x: normalize_tag(x, "output")))
        return F.when(~F.contains(t, F.lit(",")) & F.contains(t, F.lit("_")) & F.contains(t, F.lit(" ")), words).otherwise(split_tags(t))

    return once(F.trim(F.coalesce(c, F.lit(""))), split)


def format_tags(c: Column) -> Column:
    """Space-separated source tags as a comma list with spaces in place of underscores."""
    return F.array_join(F.transform(_filled(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+")), _spaced), ", ")


def first_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in the order of the array; null for a null array.

    The array and its keys are each bound as the only element of an array first, so that they are built once for a row and not
    again for every element that is held against them.
    """
    first = lambda t, k: F.filter(t, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1)
    return F.flatten(F.transform(F.array(a), lambda t: F.flatten(F.transform(F.array(F.transform(t, key)), lambda k: first(t, k)))))


def dedupe_ci(a: Column) -> Column:
    """First spelling of each tag, compared without case; blanks go."""
    return first_by(_filled(F.transform(a, lambda x: normalize_tag(x, "output"))), lambda x: F.lower(x))


def escape_parentheses(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("("), F.lit(r"\(")), F.lit(")"), F.lit(r"\)"))


def clean_tag(c: Column, keep: list[str]) -> Column:
    """Display form with escaped parentheses; tags in `keep` (emoticons) keep their underscores."""
    return escape_parentheses(F.when(c.isin(keep), c).otherwise(_spaced(c)))


def prefix_tags(a: Column, prefix: str = "@") -> Column:
    tags = _filled(F.transform(a, lambda x: normalize_tag(x, "output")))
    return F.transform(tags, lambda x: F.when(F.startswith(x, F.lit(prefix)), x).otherwise(F.concat(F.lit(prefix), x)))


# Score limits for the two rating groups, label names, year limits, rating names.
SAFE_LIMITS = (130, 70, 35, 3, -1)
OTHER_LIMITS = (230, 124, 62, 6, -1)
QUALITY_LABELS = ("masterpiece", "best quality", "good quality", "normal quality", "low quality", "worst quality")
PERIODS = ((2021, "newest"), (2018, "recent"), (2015, "mid"), (2011, "early"))
SAFE_RATINGS = ("g", "general", "safe", "s", "sensitive")


def quality_tag(score: Column, rating: Column) -> Column:
    """Label of a score cut toward zero; empty if the score is no finite number."""

    def whole(number: Column) -> Column:
        return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))

    def label_of(x: Column) -> Column:
        out = F.when(x["n"].isNull(), "")
        for a, b, label in zip(SAFE_LIMITS, OTHER_LIMITS, QUALITY_LABELS, strict=False):
            out = out.when(x["n"] > F.when(x["safe"], a).otherwise(b), label)
        return out.otherwise(QUALITY_LABELS[-1])

    safe = F.coalesce(F.lower(F.trim(rating)).isin(*SAFE_RATINGS), F.lit(False))
    return once(F.struct(once(F.trim(score.cast("string")).try_cast("double"), whole).alias("n"), safe.alias("safe")), label_of)


def normalize_quality(c: Column) -> Column:
    return once(_spaced(F.lower(strip(c))), lambda t: F.when(t == "high quality", "good quality").when(t == "medium quality", "normal quality").otherwise(t))


def is_quality(c: Column, known: tuple[str, ...] = QUALITY_LABELS) -> Column:
    t = F.lower(F.trim(c))
    return t.isin(*known) | F.endswith(t, F.lit(" quality"))


ISO = r"^\s*(\d{4})-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*$"
LONG_DATE = r"^\s*[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} (\d{4})\s*$"


def period_tag(created_at: Column) -> Column:
    """Period of the year in the timestamp's own offset; empty if it is no ISO date."""

    def label_of(year: Column) -> Column:
        out = F.when(year.isNull(), "")
        for least, label in PERIODS:
            out = out.when(year >= least, label)
        return out.otherwise("old")

    return once(F.regexp_extract(F.coalesce(created_at, F.lit("")), ISO, 1).try_cast("int"), label_of)


def year_tag(created_at: Column) -> Column:
    """`year YYYY` of an ISO or a long date, in its own offset; else empty."""
    c = F.coalesce(created_at, F.lit(""))
    year = F.concat(F.regexp_extract(c, ISO, 1), F.regexp_extract(c, LONG_DATE, 1))
    return once(year, lambda y: F.when(y != "", F.concat(F.lit("year "), y)).otherwise(""))


def safety_tags(rating: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(rating, F.lit(""))))
    return (
        F.when(r.isin("e", "explicit"), F.array(F.lit("explicit"), F.lit("nsfw")))
        .when(r.isin("q", "questionable"), F.array(F.lit("nsfw")))
        .when(r.isin("s", "sensitive"), F.array(F.lit("sensitive")))
        .when(r.isin("g", "general"), F.array(F.lit("safe")))
        .otherwise(F.array().cast("array<string>"))
    )


def normalize_rating(c: Column) -> Column:
    """One-letter rating; the second source's `safe` and `sensitive` are both s, unknown names become empty."""
    r = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(r.isin("g", "general"), "g").when(r.isin("s", "safe", "sensitive"), "s").when(r.isin("q", "questionable"), "q").when(r.isin("e", "explicit"), "e").otherwise("")


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def iso_created_at(c: Column) -> Column:
    """A long date in ISO form with its own offset; anything else stays as it is."""
    part = lambda i: F.regexp_extract(c, r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2})(\d{2}) (\d{4})$", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(1))
    iso = F.concat(part(6), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("T"), part(3), part(4), F.lit(":"), part(5))
    return F.when((part(6) != "") & (month > 0), iso).otherwise(c)


def display_name(c: Column) -> Column:
    """A character's name without what stands in parentheses."""
    return _collapse(_spaced(F.regexp_replace(c, r"[\s_]*\([^)]*\)", "")))


def character_key(c: Column) -> Column:
    return normalize_tag(c, "character")


def site_key(c: Column) -> Column:
    """A tag as sites store it: trimmed, unescaped, lower case, with underscores."""
    return normalize_tag(c, "compare")


def candidate_keys(c: Column) -> Column:
    """Spellings under which a tag may be stored, distinct, in order of preference."""
    plain = _unescape(F.trim(c))
    cache = normalize_tag(c, "cache")
    return F.array_distinct(F.array(c, plain, F.lower(plain), cache, F.replace(cache, F.lit(" "), F.lit("_"))))


def set_quality(c: Column, label: str) -> Column:
    """Quality tags of a comma list replaced by one label at the front; text after the first `. ` and a last line break stay."""
    at = F.instr(c, ". ")
    head = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.regexp_replace(c, r"\n$", ""))
    tail = F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(F.when(F.endswith(c, F.lit("\n")), "\n").otherwise(""))
    tags = F.filter(F.transform(F.split(head, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~is_quality(x))
    return F.concat(F.array_join(F.concat(F.array(F.lit(label)), tags), ", "), tail)


def combined_text(tags: Column, short: Column) -> Column:
    return F.concat_ws(". ", tags, short)


def stable_tags(a: Column) -> Column:
    """Tags in the order of their lower-case forms, then of themselves."""
    return F.transform(F.array_sort(F.transform(a, lambda x: F.struct(F.lower(x).alias("k"), x.alias("t")))), lambda x: x["t"])
