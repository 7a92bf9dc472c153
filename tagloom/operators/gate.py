"""Admission: which records, posts and requests enter a pipeline.

The gate A1 drops records by their tags. Its own words block a tag that is one of them or holds one as a word, so that compounds
(with a space, a hyphen or parentheses) don't pass; they are part of an expression. Callers add whole tags to them and can't
take any away. Tags in a row are judged in that row, without a shuffle; a caller's table of more than some hundred tags is
joined instead.

Rule tables are arguments. Tables that a caller is meant to keep small (rules, folders, ratings) are left to the
planner, which broadcasts them by their size; nothing is forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.literals import small_rows

#: Words that always block a record, alone or inside a tag: minors in words, and animated posts.
ALWAYS_BLOCKED = (
    "age regression",
    "aged down",
    "animated",
    "child",
    "childlike",
    "children",
    "infant",
    "infants",
    "juvenile",
    "kid",
    "kids",
    "kindergarten",
    "kindergartener",
    "loli",
    "lolicon",
    "lolidom",
    "lolis",
    "minor",
    "minors",
    "preschool",
    "preschooler",
    "preteen",
    "preteens",
    "prepubescent",
    "schoolboy",
    "schoolchild",
    "schoolchildren",
    "shota",
    "shotacon",
    "shotadom",
    "shotas",
    "teen",
    "teenage",
    "teenager",
    "teenagers",
    "teens",
    "toddler",
    "toddlercon",
    "toddlers",
    "tween",
    "underage",
    "underaged",
)
MD5 = r"^[0-9a-f]{32}$"
IMAGE_TYPES = ("jpg", "jpeg", "png", "webp")


def unescape_html(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def blocking_form(tag: Column) -> Column:
    """What tags are compared by: unescaped, lower case, with spaces."""
    return F.lower(F.replace(F.trim(unescape_html(tag)), F.lit("_"), F.lit(" ")))


def always_blocked(tag: Column) -> Column:
    """The words of a tag that block it in any case, as they occur; null for a null tag."""
    words = "|".join(w.replace(" ", r"[\s-]+") for w in sorted(ALWAYS_BLOCKED, key=len, reverse=True))
    found = F.regexp_extract_all(blocking_form(tag), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, r"[\s-]+", " "))


def _forms(blocked: DataFrame) -> DataFrame:
    return blocked.where("tag is not null").select(blocking_form(F.col("tag")).alias("_blocked")).distinct()


def _own_matches(tag: Column, forms: list[str]) -> Column:
    """The array of what blocks a tag: always-blocked words in it, and itself if it is among forms."""
    words = F.coalesce(always_blocked(tag), F.array().cast("array<string>"))
    if not forms:
        return words
    form = blocking_form(tag)
    return F.when(F.coalesce(form.isin(forms), F.lit(False)), F.concat(words, F.array(form))).otherwise(words)


def tag_matches(record_tags: DataFrame, blocked: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """record_tags with `_matches`, what blocks each tag."""
    rows = [] if blocked is None else small_rows(_forms(blocked), small)
    if rows is not None:
        return record_tags.withColumn("_matches", _own_matches(F.col("tag"), [r[0] for r in rows]))
    joined = record_tags.join(_forms(blocked), blocking_form(F.col("tag")) == F.col("_blocked"), "left")
    return joined.withColumn("_matches", F.array_compact(F.array_append(_own_matches(F.col("tag"), []), F.col("_blocked")))).drop("_blocked")


def gate_records(record_tags: DataFrame, blocked: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(record_id, matched): each record once, with what blocks it in order (nothing: empty). Only matches are gathered."""
    rows = tag_matches(record_tags, blocked, small).select("record_id", F.explode_outer("_matches").alias("m"))
    return rows.groupBy("record_id").agg(F.array_sort(F.collect_set("m")).alias("matched"))


def blocked_matches(record_tags: DataFrame, blocked: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(record_id, matched): what blocks each record that is blocked, in order; no other record is shuffled."""
    rows = tag_matches(record_tags, blocked, small).select("record_id", F.explode("_matches").alias("m"))
    return rows.groupBy("record_id").agg(F.array_sort(F.collect_set("m")).alias("matched"))


def exclude_blocked(record_tags: DataFrame, blocked: DataFrame | None = None, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A1: the tags of records without a blocked tag, and (record_id, matched) of the rest.

    The ids of blocked records are held against the tags, by broadcast where the planner finds them few. Rows without an id
    are one record. A null tag blocks nothing.
    """
    rejects = blocked_matches(record_tags, blocked, small)
    kept = record_tags.join(rejects.select(F.col("record_id").alias("_id")), F.col("record_id").eqNullSafe(F.col("_id")), "left_anti")
    return kept, rejects


def with_matches(records: DataFrame, col: str, blocked: DataFrame | None = None, key: str = "record_id", small: int | None = None) -> DataFrame:
    """records with `matched`: what blocks the tags in array column `col`, in order. A null array has nothing.

    In the row, unless blocked has many tags: then those of the array are joined, and meet again by key.
    """
    rows = [] if blocked is None else small_rows(_forms(blocked), small)
    none = F.array().cast("array<string>")
    if rows is not None:
        forms = [r[0] for r in rows]
        found = F.flatten(F.transform(F.filter(col, lambda t: t.isNotNull()), lambda t: _own_matches(t, forms)))
        return records.withColumn("matched", F.coalesce(F.array_sort(F.array_distinct(found)), none))
    tags = records.select(F.col(key).alias("record_id"), F.explode(col).alias("tag"))
    bad = blocked_matches(tags, blocked, small).select(F.col("record_id").alias("_id"), F.col("matched").alias("_matched"))
    joined = records.join(bad, F.col(key).eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("matched", F.coalesce("_matched", none)).drop("_id", "_matched")


def exclude_blocked_rows(records: DataFrame, col: str = "tags", blocked: DataFrame | None = None, key: str = "record_id", small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A1 for tags in a row: records (with an array of tags) that nothing blocks, and the others with `matched`."""
    judged = with_matches(records, col, blocked, key, small)
    return judged.where(F.size("matched") == 0).drop("matched"), judged.where(F.size("matched") > 0)


def valid_ids(df: DataFrame, col: str) -> DataFrame:
    """A2: distinct content ids, trimmed and lower-cased; others go."""
    return df.select(F.lower(F.trim(col)).alias(col)).where(F.col(col).rlike(MD5)).distinct()


def missing_ids(ids: DataFrame, existing: DataFrame, key: str = "md5") -> DataFrame:
    """A3: ids that no folder has."""
    return ids.join(existing.select(key), key, "left_anti")


def locate_existing(ids: DataFrame, existing: DataFrame, key: str = "md5") -> DataFrame:
    """A3: for ids that a folder has, the location of lowest priority number."""
    return ids.join(existing, key).groupBy(key).agg(F.min_by("location", F.struct("priority", "location")).alias("location"))


def select_pairs(records: DataFrame, ids: DataFrame, partner: str, key: str = "md5") -> DataFrame:
    """A4: records among ids that have their partner file."""
    return records.where(F.col(partner).isNotNull()).join(ids.select(key), key, "left_semi")


def match_records(records: DataFrame, keywords: list[str], excluded: list[str], mode: str = "AND", contains: str = "") -> DataFrame:
    """A5: records (tags array) with all or any keywords, or with a tag that contains a string, and no excluded tag."""
    hits = [F.array_contains("tags", k) for k in keywords]
    tagged = F.lit(False)
    for i, h in enumerate(hits):
        tagged = h if i == 0 else (tagged & h if mode == "AND" else tagged | h)
    part = F.exists("tags", lambda t: F.contains(t, F.lit(contains))) if contains else F.lit(False)
    out = records.where(tagged | part)
    return out.where(~F.arrays_overlap("tags", F.array(*map(F.lit, excluded)))) if excluded else out


def select_bundles(records: DataFrame, files: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of matched records that the target lacks, and counts of records matched, files moved and skipped."""
    mine = files.join(records.select("record_id"), "record_id", "left_semi")
    moved = mine.join(target.select("name"), "name", "left_anti")
    counts = mine.agg(F.count_distinct("record_id").alias("matched"), F.count("*").alias("files")).crossJoin(moved.agg(F.count("*").alias("moved")))
    return moved, counts.select("matched", "moved", (F.col("files") - F.col("moved")).alias("skipped"))


def filter_posts(posts: DataFrame, rating: str, required_tag: str | None = None) -> DataFrame:
    """Posts of a rating (by any of its names) that have a required tag."""
    from tagloom.functions.norm import normalize_rating

    out = posts.where(normalize_rating(F.col("rating")) == rating)
    return out.where(F.array_contains("tags", required_tag)) if required_tag else out


SCORE = r"^score:(>=|<=|>|<|=)?(-?\d+)$"
# The names of ratings that a search can ask for.
RATING_NAMES = ("g", "general", "s", "sensitive", "safe", "q", "questionable", "e", "explicit")


def parse_query(df: DataFrame, col: str = "query") -> DataFrame:
    """Tag, rating, score_op, score_value, flag and valid of a search string.

    Sort words are dropped. Valid means one positive tag beside at most one rating of a known name, one score filter and the flag
    tag. A query that is only the flag tag has it as its tag. A null query has no tag and is not valid.
    """
    words = F.filter(F.split(F.lower(F.trim(col)), r"\s+"), lambda w: (w != "") & ~w.isin("order:score", "sort:score"))
    df = df.withColumn("_w", words)
    ratings = F.filter("_w", lambda w: F.startswith(w, F.lit("rating:")))
    scores = F.filter("_w", lambda w: w.rlike(SCORE))
    tags = F.filter("_w", lambda w: ~F.startswith(w, F.lit("rating:")) & ~w.rlike(SCORE))
    df = df.withColumn("_r", ratings).withColumn("_s", scores).withColumn("_t", tags)
    flag = (F.size("_t") > 1) & (F.size(F.filter("_t", lambda w: w == "official_art")) == 1)
    df = df.withColumn("flag", flag).withColumn("_t", F.when(flag, F.array_remove("_t", "official_art")).otherwise(F.col("_t")))
    tag, score = F.get("_t", F.lit(0)), F.get("_s", F.lit(0))
    rating = F.substring(F.get("_r", F.lit(0)), F.lit(8), F.length(F.get("_r", F.lit(0))))
    valid = (F.size("_t") == 1) & (F.size("_s") <= 1) & (F.size("_r") <= 1) & (rating.isNull() | rating.isin(*RATING_NAMES)) & ~F.coalesce(F.startswith(tag, F.lit("-")), F.lit(True)) & ~tag.rlike("^(order|sort|score):")
    out = df.select(
        *[c for c in df.columns if not c.startswith("_") and c != "flag"],
        tag.alias("tag"),
        rating.alias("rating"),
        F.when(score.isNotNull(), F.when(F.regexp_extract(score, SCORE, 1) == "", "=").otherwise(F.regexp_extract(score, SCORE, 1))).alias("score_op"),
        F.regexp_extract(score, SCORE, 2).try_cast("int").alias("score_value"),
        "flag",
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    return out


def score_matches(score: Column, op: Column, value: Column) -> Column:
    """Whether a score passes op and value; no op passes all."""
    return F.when(op.isNull(), True).when(op == ">=", score >= value).when(op == "<=", score <= value).when(op == ">", score > value).when(op == "<", score < value).otherwise(score == value)


def triage_posts(posts: DataFrame, existing: DataFrame, blocked: DataFrame) -> DataFrame:
    """A10: posts (id, md5, tags, file_url, file_ext) with outcome: blacklisted, unavailable, skipped or eligible."""
    have = existing.select(F.lower("md5").alias("_md5")).distinct().withColumn("_have", F.lit(True))
    df = with_matches(posts, "tags", blocked, "id").withColumn("_bad", F.size("matched") > 0).join(have, F.lower(F.col("md5")) == F.col("_md5"), "left")
    outcome = (
        F.when(F.col("_bad"), "blacklisted")
        .when(~F.coalesce(F.lower("md5").rlike(MD5), F.lit(False)), "unavailable")
        .when(F.col("_have"), "skipped")
        .when(~F.coalesce(F.startswith(F.lower("file_url"), F.lit("https://")), F.lit(False)), "unavailable")
        .when(~F.coalesce(F.lower("file_ext").isin(*IMAGE_TYPES), F.lit(False)), "unavailable")
        .otherwise("eligible")
    )
    return df.select(*posts.columns, outcome.alias("outcome"))


def reference_candidates(meta: DataFrame, existing: DataFrame, attempted: DataFrame, excluded: DataFrame, model: str) -> DataFrame:
    """Records (record_id, md5, characters array, tags array) that can show one character alone.

    No tag may contain an excluded word, the character must have no reference, and (character, md5, model) must be untried.
    """
    one = meta.where((F.size("characters") == 1) & F.array_contains("tags", "solo")).withColumn("character", F.get("characters", F.lit(0)))
    one = one.join(excluded.select("word"), F.exists("tags", lambda t: F.contains(t, F.col("word"))), "left_anti")
    one = one.join(existing.select("character"), "character", "left_anti")
    return one.join(attempted.where(F.col("model") == model).select("character", "md5"), ["character", "md5"], "left_anti").select("record_id", "md5", "character")


def discovery_filter(tags: DataFrame, category: int, min_posts: int, since: str) -> DataFrame:
    """Remote tags of a category with enough posts, in use, created at or after a time, without white space."""
    return tags.where((F.col("category") == category) & (F.col("post_count") >= min_posts) & ~F.coalesce("is_deprecated", F.lit(False)) & (F.col("created_at") >= F.lit(since).cast("timestamp")) & ~F.col("name").rlike(r"\s"))


def pending_records(records: DataFrame, outputs: DataFrame, reports: DataFrame, meta: DataFrame) -> DataFrame:
    """record_id with status complete, cached, missing_metadata or pending."""
    flag = lambda df, name: df.select("record_id").distinct().withColumn(name, F.lit(True))
    df = records.select("record_id").join(flag(outputs, "_o"), "record_id", "left").join(flag(reports, "_r"), "record_id", "left").join(flag(meta, "_m"), "record_id", "left")
    return df.select("record_id", F.when(F.col("_o"), "complete").when(F.col("_r"), "cached").when(F.col("_m").isNull(), "missing_metadata").otherwise("pending").alias("status"))


def stage_work(records: DataFrame, needs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each stage, how many records have its input column but not its output column; one pass."""
    counts = records.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias(s) for s, (a, b) in needs.items()])
    return counts.unpivot([], list(needs), "stage", "records")
