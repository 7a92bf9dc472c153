"""Classes of tags: category lookup, grouping, prediction selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.norm import candidate_keys, first_by, is_quality, normalize_tag, once, site_key
from tagloom.operators.literals import small_rows
from tagloom.operators.rules import collect_tags

# Codes and names of categories, words of safety and of periods.
NAMES = {0: "general", 1: "artist", 3: "copyright", 4: "character", 5: "meta"}
SAFETY = ("safe", "sensitive", "nsfw", "explicit")
PERIODS = ("newest", "recent", "mid", "early", "old")


def resolve_category(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """(tag, category) for distinct tags: 4 if any spelling has it, else that of the first known spelling, else null."""
    keys = tags.select("tag").distinct().select("tag", F.posexplode(candidate_keys(F.col("tag"))).alias("p", "key"))
    hits = keys.join(categories.select(F.col("tag").alias("key"), "category"), "key", "left")
    best = F.when(F.bool_or(F.col("category") == 4), 4).otherwise(F.min_by("category", F.when(F.col("category").isNotNull(), F.struct("p", "category"))))
    return hits.groupBy("tag").agg(best.alias("category"))


def _fixed(t: Column) -> Column:
    """The class of quality, safety and period words, else null."""
    low = F.lower(t)
    return F.when(is_quality(t), "quality").when(low.isin(*SAFETY), "safety").when(low.isin(*PERIODS), "period")


def gathered_classes(lists: DataFrame, resolved: DataFrame, known: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """`classes` of tags that are gathered by record, lists (record_id, tags in order): each record once.

    resolved (tag, category) has every tag once. What a tag alone decides is worked out for distinct tags. Up to 256 of them
    are lists in the expressions, and tags are sorted into classes in the row; more are joined by tag and gathered again, with
    the same rows.
    """
    info = resolved.where("tag is not null").select("tag", site_key(F.col("tag")).alias("key"), _fixed(F.col("tag")).alias("fixed"), "category")
    few = small_rows(info, small)
    stated = None
    if known is not None:
        stated = known.groupBy("record_id", site_key(F.col("tag")).alias("key")).agg(F.max("category").alias("category"))
        stated = stated.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "category"))).alias("_own"))
    own_category = lambda key: F.when(F.col("_own").isNotNull(), F.try_element_at("_own", key)) if known is not None else F.lit(None).cast("int")
    if few is None:
        found = lists.select("record_id", F.posexplode("tags").alias("pos", "tag")).join(info, "tag")
        own = found.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tag", "key", "fixed", "category"))).alias("tags"))
        own = lists.select("record_id").join(own, "record_id", "left").select("record_id", F.coalesce("tags", F.array().cast(own.schema["tags"].dataType)).alias("tags"))
        own = own.withColumn("tags", first_by(F.col("tags"), lambda r: r["key"]))
    else:
        shared = len({r.key for r in few}) < len(few)
        first = first_by(F.array_distinct("tags"), site_key) if shared else F.array_compact(F.array_distinct("tags"))
        own = lists.select("record_id", first.alias("tags"))
    if stated is not None:
        own = own.join(stated, "record_id", "left")

    def of(fixed: str | None, code: int | None) -> Column:
        """Tags of a fixed class, or of a category, or, if both are null, without a class."""
        if few is None:

            def test(r: Column) -> Column:
                category = F.coalesce(own_category(r["key"]), r["category"])
                here = F.coalesce(~category.isin(*NAMES), F.lit(True)) if code is None else category == code
                return r["fixed"] == fixed if fixed else r["fixed"].isNull() & here

            return F.transform(F.filter("tags", test), lambda r: r["tag"])
        if fixed:
            return F.filter("tags", lambda t: t.isin([r.tag for r in few if r.fixed == fixed]))
        free = [r for r in few if r.fixed is None]
        mine = [r.tag for r in free if (r.category not in NAMES if code is None else r.category == code)]
        if known is None:
            return F.filter("tags", lambda t: t.isin(mine))

        def test_own(t: Column) -> Column:
            own_ = own_category(site_key(t))
            here = once(own_, lambda c: F.when(c.isNull(), t.isin(mine)).otherwise(~c.isin(*NAMES) if code is None else c == code))
            return t.isin([r.tag for r in free]) & here

        return F.when(F.col("_own").isNull(), F.filter("tags", lambda t: t.isin(mine))).otherwise(F.filter("tags", test_own))

    out = [of(n, None).alias(n) for n in ("quality", "safety", "period")] + [of(None, code).alias(name) for code, name in NAMES.items()]
    return own.select("record_id", *out, F.sort_array(of(None, None)).alias("unresolved"))


def classes(rt: DataFrame, categories: DataFrame, known: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(record_id, a list per class, unresolved): each record's tags by first position, unresolved ones in order.

    Quality, safety and period words come first; categories that a record itself states, known (record_id, tag, category), beat
    the lookup, the largest where it states several. Tags and stated ones meet by their site keys, and of several spellings
    with one key only the first stays. A record's tags meet once.
    """
    return gathered_classes(collect_tags(rt), resolve_category(rt, categories), known, small)


def split_classes(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without unresolved tags, and rejects (record_id, unresolved)."""
    # An array of none or one is exploded: a filter would be pushed down and build the list twice.
    some = F.explode(F.filter(F.array("unresolved"), lambda u: F.size(u) > 0))
    return out.where(F.size("unresolved") == 0).drop("unresolved"), out.select("record_id", some.alias("unresolved"))


def classify_tags(rt: DataFrame, categories: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C14: (record_id, and a list per class), and rejects (record_id, unresolved): records with any unresolved tag."""
    return split_classes(classes(rt, categories, known))


def merge_categories(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(tag, category, name) over sources (tag, category) in order, and the number of blank tags.

    The first source that has a tag wins, but 4 always does; codes without a name are Unknown.
    """
    every = None
    for i, s in enumerate(sources):
        part = s.select(normalize_tag(F.col("tag"), "stats").alias("tag"), "category", F.lit(i).alias("p"))
        every = part if every is None else every.unionAll(part)
    blank = F.coalesce(F.trim("tag") == "", F.lit(True))
    first = F.min_by("category", F.struct("p", "category"))
    merged = every.where(~blank).groupBy("tag").agg(F.when(F.bool_or(F.col("category") == 4), 4).otherwise(first).alias("category"))
    name = F.lit("Unknown")
    for code, n in NAMES.items():
        name = F.when(F.col("category") == code, n.capitalize()).otherwise(name)
    return merged.withColumn("name", name), every.agg(F.count_if(blank).alias("invalid"))


def group_post_tags(posts: DataFrame, categories: DataFrame, small: int | None = None) -> DataFrame:
    """C17: (id, a sorted list per category) of posts (id, tags array); tags without a category are general.

    Rows of one id are put together; ids without tags are left out. A table of up to 256 rows is looked up in the row, a
    larger one is joined, with the same rows.
    """
    named = categories.where("tag is not null").select("tag", F.coalesce("category", F.lit(0)).alias("category")).distinct()
    few = small_rows(named, small)
    if few is None:
        own = posts.select("id", F.explode("tags").alias("tag")).distinct()
        df = own.join(named, "tag", "left").withColumn("category", F.coalesce("category", F.lit(0)))
        return df.groupBy("id").agg(*[F.sort_array(F.collect_list(F.when(F.col("category") == code, F.col("tag")))).alias(name) for code, name in NAMES.items()])
    own = posts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags")).where(F.size("tags") > 0)

    def of(code: int) -> Column:
        mine = [r.tag for r in few if r.category == code]
        return F.filter("tags", lambda t: t.isin(mine) | (F.lit(code == 0) & ~t.isin([r.tag for r in few])))

    return own.select("id", *[F.sort_array(of(code)).alias(name) for code, name in NAMES.items()])


def unclassified_tags(rt: DataFrame, categories: DataFrame, batch: int = 100) -> DataFrame:
    """(tag, batch): distinct tags without a category, dealt into batches by hash, about `batch` in each."""
    left = rt.select("tag").distinct().join(categories.select("tag"), "tag", "left_anti")
    n = left.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / batch)).alias("_n"))
    return left.crossJoin(F.broadcast(n)).select("tag", (F.crc32(F.col("tag").cast("binary")) % F.col("_n")).alias("batch"))


def validate_label_table(labels: DataFrame, categories: tuple[int, ...] = (0, 4, 9)) -> DataFrame:
    """A0h: (label, reason) of label rows that are blank, repeated, or of an unknown category."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("category").alias("category"), F.max(F.when(~F.col("category").isin(*categories), 1)).alias("odd"))
    reason = F.when(F.coalesce(F.trim("label") == "", F.lit(True)), "blank").when(F.col("n") > 1, "repeated").when(F.col("odd") == 1, "category")
    return counts.select("label", reason.alias("reason")).where("reason is not null")


def select_predicted(scores: DataFrame, labels: DataFrame, banned: DataFrame, fallback: dict[int, float], override: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(record_id, rank, label, score) by descending score, and rejects (record_id).

    scores (record_id, label, score), labels (label, category, threshold). A label's own threshold counts if it lies in
    [0, 1], else its category's. Labels of categories without one (ratings) are never selected, but need a score as well; banned
    tags are met by their site keys. Labels are the rows of a model's table and go to every task, since by label the scores would
    meet in as few tasks as there are labels. Records with scores that are missing, doubled, not finite or outside [0, 1] are rejected.
    """
    odd = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    total = labels.agg(F.count("*").alias("_total"))
    per = scores.join(F.broadcast(labels.select("label")), "label", "left_semi").groupBy("record_id", "label").agg(F.count("*").alias("n"), F.max(odd.cast("int")).alias("odd"))
    per = per.groupBy("record_id").agg(F.count("*").alias("n_labels"), F.max("n").alias("n"), F.max("odd").alias("odd")).crossJoin(F.broadcast(total))
    rejects = per.where((F.col("odd") == 1) | (F.col("n") > 1) | (F.col("n_labels") != F.col("_total"))).select("record_id")
    by = F.lit(None).cast("double")
    for code, limit in fallback.items():
        by = F.when(F.col("category") == code, F.lit(limit)).otherwise(by)
    limit = F.lit(override) if override is not None else F.when(F.col("threshold").between(0, 1), F.col("threshold")).otherwise(by)
    usable = labels.where(F.col("category").isin(*fallback)).withColumn("_key", site_key(F.col("label"))).join(banned.select(site_key(F.col("label")).alias("_key")), "_key", "left_anti").drop("_key")
    good = scores.join(rejects, "record_id", "left_anti").join(F.broadcast(usable), "label").where(F.col("score") >= limit)
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("score"), "label"))
    return good.select("record_id", rank.alias("rank"), "label", "score"), rejects


def append_missing(existing: DataFrame, predicted: DataFrame) -> DataFrame:
    """C20: (record_id, tags): existing tags in order, then predicted ones that no existing tag equals in compare form."""
    df = existing.join(predicted.withColumnRenamed("tags", "_p"), "record_id", "left")
    key = lambda t: normalize_tag(t, "compare")
    # Predicted tags become distinct first, so each is brought to its form once, and existing ones once for all of them.
    new = F.array_distinct(F.coalesce("_p", F.array().cast("array<string>")))
    more = F.flatten(F.transform(F.array(F.transform("tags", key)), lambda k: F.filter(new, lambda t: ~F.array_contains(k, key(t)))))
    return df.select("record_id", F.concat("tags", more).alias("tags"))


def check_vocabulary(rt: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(record_id, outside): records with tags outside vocabulary (tag), and those tags sorted."""
    return rt.join(vocabulary.select("tag"), "tag", "left_anti").groupBy("record_id").agg(F.array_sort(F.collect_set("tag")).alias("outside"))
