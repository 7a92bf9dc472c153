"""The inverted index of tags as files (E6): which records hold a tag, in which folders.

Rows are dealt to buckets by their tag, sorted by tag in each, and every bucket is one file, so the statistics of its row groups
leave out all but those of a tag. A tag with more than `rows` rows is dealt to as many buckets as it needs, by its records;
a small table beside the index names these tags. A lookup computes a tag's buckets and reads their files only: one, or as
many as `width` tells for a common tag. The number of buckets follows from the number of rows. A task writes all buckets that
it gets, one after the other, so small buckets make many files but not as many tasks and pieces of a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.stats import inverted_index
from tagloom.sources.shared import checkpoint

#: Rows of a bucket, about.
ROWS = 4_000_000


def _home(tag: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(buckets) if isinstance(buckets, int) else buckets)


def _tasks(spark: SparkSession, total: int, buckets: int) -> int:
    """At most one for each bucket, and for as many rows as a bucket has by default, but enough for the session's cores."""
    return min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS)))


def write_index(rt: DataFrame, path: str, rows: int = ROWS) -> None:
    """Write the index of rt (record_id, folder, tag); repeated rows count once, null tags are left out."""
    spark = rt.sparkSession
    index = checkpoint(inverted_index(rt.where("tag is not null")))
    counts = checkpoint(index.groupBy("tag").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-total // rows))
    # At most total / rows tags.
    wide = counts.where(F.col("n") > rows).select("tag", F.least(F.ceil(F.col("n") / rows), F.lit(buckets)).cast("int").alias("width"))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/buckets")
    wide.coalesce(1).sortWithinPartitions("tag").write.parquet(f"{path}/wide")
    dealt = index.join(F.broadcast(wide), "tag", "left")
    share = F.when(F.col("width").isNotNull(), F.pmod(F.xxhash64("record_id", "folder"), F.col("width"))).otherwise(0)
    dealt = dealt.withColumn("bucket", F.pmod(_home(F.col("tag"), buckets) + share, F.lit(buckets)).cast("int")).drop("width")
    dealt.repartition(_tasks(spark, total, buckets), "bucket").sortWithinPartitions("bucket", "tag", "folder", "record_id").write.partitionBy("bucket").parquet(f"{path}/rows")


def buckets_of(spark: SparkSession, path: str, tags: list[str]) -> list[int]:
    """The buckets that hold the tags."""
    n = spark.read.parquet(f"{path}/buckets").first().buckets
    asked = spark.createDataFrame([(t,) for t in tags], "tag string").join(spark.read.parquet(f"{path}/wide").where(F.col("tag").isin(tags)), "tag", "left")
    own = asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("width", F.lit(1)) - 1), lambda i: F.pmod(_home(F.col("tag"), n) + i, F.lit(n)))).alias("b"))
    return sorted({int(r.b) for r in own.collect()})


def lookup(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """(tag, folder, record_id) of some tags, from the files of their buckets."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("bucket").isin(buckets_of(spark, path, tags)) & F.col("tag").isin(tags)).select("tag", "folder", "record_id")
