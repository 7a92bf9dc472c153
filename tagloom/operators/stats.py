"""Tag statistics over record_tags (record_id, folder, tag).

A record can be in several folders and hold a tag more than once; it counts once. Distinct pairs are formed with
map-side aggregation before anything is counted, so a frequent tag is spread over its records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_counts(rt: DataFrame) -> DataFrame:
    """(tag, images)"""
    return rt.select("tag", "record_id").distinct().groupBy("tag").agg(F.count("*").alias("images"))


def tag_counts_by_folder(rt: DataFrame, folders: list[str]) -> DataFrame:
    """(tag, images, a column per folder); one pass over distinct (tag, record, folder)."""
    pairs = rt.groupBy("tag", "record_id").agg(*[F.max((F.col("folder") == f).cast("int")).alias(f) for f in folders])
    return pairs.groupBy("tag").agg(F.count("*").alias("images"), *[F.sum(F.col(f"`{f}`")).alias(f) for f in folders])


def dataset_summary(records: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images, readable, missing, empty, orphans; records (record_id), sidecars (record_id, text)."""
    df = records.select("record_id", F.lit(1).alias("_i")).join(sidecars.select("record_id", "text", F.lit(1).alias("_s")), "record_id", "full_outer")
    image, side, filled = F.col("_i").isNotNull(), F.col("_s").isNotNull(), F.coalesce(F.trim("text") != "", F.lit(False))
    return df.agg(F.count_if(image).alias("images"), F.count_if(image & side & filled).alias("readable"), F.count_if(image & ~side).alias("missing"), F.count_if(image & side & ~filled).alias("empty"), F.count_if(side & ~image).alias("orphans"))


def category_histogram(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, tags); tags without a category are Unknown."""
    return counts.join(categories, "tag", "left").groupBy(F.coalesce(F.col("category").cast("string"), F.lit("Unknown")).alias("category")).agg(F.count_distinct("tag").alias("tags"))


def tag_stats(counts: DataFrame, categories: DataFrame, total: DataFrame, least: int = 1, most: int | None = None, contains: str = "", category: str | None = None, sort: tuple[str, bool] = ("images", True)) -> DataFrame:
    """E5: counts with category and percent of all images, filtered and sorted; ties go by tag in the same direction.

    total is one row (total); where it is 0, so are all percentages.
    """
    df = counts.join(categories, "tag", "left").withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("Unknown")))
    df = df.crossJoin(F.broadcast(total.select(F.col("total").alias("_total"))))
    df = df.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("images") * F.lit(100.0), F.col("_total")), 2), F.lit(0.0))).drop("_total")
    df = df.where(F.col("images") >= least)
    if most is not None:
        df = df.where(F.col("images") <= most)
    if contains:
        df = df.where(F.contains(F.col("tag"), F.lit(contains)))
    if category is not None:
        df = df.where(F.col("category") == category)
    way = F.desc if sort[1] else F.asc
    return df.orderBy(way(sort[0]), way("tag"))


def records_for_tag(rt: DataFrame, tag: str) -> DataFrame:
    """(folder, record_id) of the records that hold a tag."""
    return rt.where(F.col("tag") == tag).select("folder", "record_id").distinct()


def inverted_index(rt: DataFrame) -> DataFrame:
    """Distinct (tag, folder, record_id); `sources.index` writes it for drill-down."""
    return rt.select("tag", "folder", "record_id").distinct()
