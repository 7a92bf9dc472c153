"""Final tag lists and context columns of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import norm
from tagloom.operators.rules import split_by_membership

NONE = F.array
# The columns of a metadata row.
FIELDS = ("md5", "post_id", "post_source", "characters", "copyright", "artists", "general", "meta", "rating", "safety tags", "period", "source", "score", "quality tag", "created_at", "year tag")


def _one(c: Column) -> Column:
    return F.filter(F.array(c), lambda x: x != "")


def quality_of(meta: DataFrame) -> Column:
    """C11q: the label derived from score and rating, else the stored one."""
    derived = norm.quality_tag(norm.get_column(meta, "score"), norm.get_column(meta, "rating"))
    return norm.once(derived, lambda d: F.when(d != "", d).otherwise(norm.normalize_quality(norm.get_column(meta, "quality tag", "quality"))))


def safety_of(meta: DataFrame) -> Column:
    """C11s: the tags of the rating, else the stored ones."""
    rated = norm.safety_tags(norm.get_column(meta, "rating"))
    return norm.once(rated, lambda r: F.when(F.size(r) > 0, r).otherwise(norm.split_tags(norm.get_column(meta, "safety tags", "safety"))))


def assemble_tags(meta: DataFrame, general: Column, count_tags: list[str], allowed_meta: list[str], excluded: list[str], add_year: bool = False, add_series: bool = False) -> DataFrame:
    """C11: meta with `tag_list`: quality, meta, period, year, safety, counts, characters, series, artists, general.

    First spellings stay, compared without case; excluded tags go.
    """
    get = lambda *names: norm.get_column(meta, *names)
    quality, safety = quality_of(meta), safety_of(meta)
    media = F.filter(norm.split_meta(get("meta", "metatags", "meta tags")), lambda t: F.lower(t).isin(allowed_meta))
    period = F.when(get("period") != "", norm.normalize_tag(get("period"), "output")).otherwise(norm.period_tag(get("created_at", "created at")))
    year = F.when(get("year tag") != "", get("year tag")).otherwise(norm.year_tag(get("created_at", "created at"))) if add_year else F.lit("")
    counts, others = split_by_membership(general, count_tags)
    series = norm.split_or_single(get("copyright", "copyrights", "copytags")) if add_series else F.array().cast("array<string>")
    artists = norm.prefix_tags(norm.split_or_single(get("artists", "artist")))
    parts = [_one(quality), media, _one(period), _one(year), safety, counts, norm.split_or_single(get("characters", "character")), series, artists, others]
    df = meta.withColumn("_all", F.concat(*parts))
    return df.withColumn("tag_list", F.filter(norm.dedupe_ci(F.col("_all")), lambda t: ~F.lower(t).isin(excluded))).drop("_all")


def post_to_metadata(posts: DataFrame, source: str) -> DataFrame:
    """The 16 text columns of a metadata row from posts (id, md5, rating, score, created_at, tag_string_*)."""
    tags = lambda name: norm.format_tags(F.col(f"tag_string_{name}"))
    values = {
        "md5": F.col("md5"),
        "post_id": F.col("id").cast("string"),
        "post_source": F.lit(source),
        "characters": tags("character"),
        "copyright": tags("copyright"),
        "artists": tags("artist"),
        "general": tags("general"),
        "meta": tags("meta"),
        "rating": F.col("rating"),
        "safety tags": F.array_join(norm.safety_tags(F.col("rating")), ", "),
        "period": norm.period_tag(F.col("created_at")),
        "source": F.lit(""),
        "score": F.col("score").cast("string"),
        "quality tag": norm.quality_tag(F.col("score"), F.col("rating")),
        "created_at": F.col("created_at"),
        "year tag": norm.year_tag(F.col("created_at")),
    }
    return posts.select(*[values[f].alias(f) for f in FIELDS])


def enrich_metadata(new: DataFrame, old: DataFrame) -> DataFrame:
    """Non-empty old values replace new ones of the same md5; the quality label follows the score."""
    o = old.select(F.col("md5"), *[F.col(f"`{c}`").alias(f"_{c}") for c in old.columns if c != "md5"])
    df = new.join(o, "md5", "left")
    df = df.select("md5", *[F.coalesce(F.nullif(f"_{c}", F.lit("")), F.col(f"`{c}`")).alias(c) if c in old.columns else F.col(f"`{c}`") for c in new.columns if c != "md5"])
    label = norm.quality_tag(F.col("score"), F.col("rating"))
    return df.withColumn("quality tag", F.when(label != "", label).otherwise(F.col("`quality tag`")))


def select_variants(rt: DataFrame, exclusions: DataFrame) -> DataFrame:
    """One tag per (record_id, display name): most parentheses, then longest, then first.

    exclusions (older, newer): older goes if its newer partner is there; all are met by their character keys.
    """
    own = rt.select("record_id", "pos", "tag", norm.character_key(F.col("tag")).alias("_key"))
    pairs = exclusions.select(norm.character_key(F.col("older")).alias("_key"), norm.character_key(F.col("newer")).alias("_newer")).distinct()
    gone = own.join(pairs, "_key").select("record_id", "_key", "_newer")
    gone = gone.join(own.select("record_id", F.col("_key").alias("_newer")).distinct(), ["record_id", "_newer"], "left_semi").select("record_id", "_key").distinct()
    df = own.join(gone, ["record_id", "_key"], "left_anti").withColumn("name", norm.display_name(F.col("tag"))).where("name <> ''")
    order = Window.partitionBy("record_id", F.lower("name")).orderBy(F.desc(F.length("tag") - F.length(F.replace(F.col("tag"), F.lit("("), F.lit("")))), F.desc(F.length("tag")), "pos")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("record_id", "pos", "tag", "name")


def scene_flags(rt: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(record_id, a boolean per flag); vocabulary (flag, term, whole): by the whole tag, or by a word of it."""
    flags = [r.flag for r in vocabulary.select("flag").distinct().orderBy("flag").collect()]  # names of columns: a rule table's keys
    words = rt.select("record_id", "tag").distinct().select("record_id", "tag", F.explode(F.array_distinct(F.concat(F.array(F.struct(F.col("tag").alias("term"), F.lit(True).alias("whole"))), F.transform(F.split("tag", " "), lambda w: F.struct(w.alias("term"), F.lit(False).alias("whole")))))).alias("x")).select("record_id", "x.term", "x.whole")
    hits = words.join(vocabulary.select("flag", "term", "whole"), ["term", "whole"], "left")
    return hits.groupBy("record_id").agg(*[F.coalesce(F.bool_or(F.col("flag") == f), F.lit(False)).alias(f) for f in flags])


def sentence_budget(df: DataFrame, cases: list[tuple[Column, int, int]], default: tuple[int, int]) -> DataFrame:
    """Df with `least` and `most` of the first case that holds."""
    least, most = F.lit(default[0]), F.lit(default[1])
    for test, a, b in reversed(cases):
        least, most = F.when(test, a).otherwise(least), F.when(test, b).otherwise(most)
    return df.withColumn("least", least).withColumn("most", most)


def lookup_references(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(record_id, name, body): the body of the best source that knows a name under any of four keys.

    Keys in order: the name, its spelling with underscores, its display name, the display name's key.
    """
    n = F.col("name")
    keys = F.array_distinct(F.array(n, F.replace(n, F.lit(" "), F.lit("_")), norm.display_name(n), norm.character_key(norm.display_name(n))))
    rows = names.select("record_id", "name", F.posexplode(keys).alias("rank", "tag"))
    hits = rows.join(refs.where(F.trim("body") != ""), "tag")
    return hits.groupBy("record_id", "name").agg(F.min_by("body", F.struct("priority", "rank", "body")).alias("body"))


def context_text(df: DataFrame, template: str) -> DataFrame:
    """Df with `context`: template with the tags (without artist tags), names and references, %s each."""
    artists = F.transform("artists", lambda a: F.lower(a))
    tags = F.filter("tags", lambda t: ~F.array_contains(artists, F.lower(t)))
    return df.withColumn("context", F.format_string(template, F.array_join(tags, ", "), F.array_join("names", ", "), F.concat_ws("\n", "references")))
