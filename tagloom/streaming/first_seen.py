"""H2: rows whose key no table and no earlier batch of a stream has, over a stream of any length.

The keys seen so far are a table in a folder, not state in memory: a batch reads it through a join with its own keys, which the
planner broadcasts where they are few, so that the table is scanned and not shuffled, and only keys that are in the batch go on.
A batch writes its rows and its new keys under its number, so that one which runs again replaces itself and doesn't see its
own keys. From time to time the keys of earlier batches are put together in as many files as there are buckets, published as a
snapshot, and of keys that are older than `keep` batches only those within stay, where that is asked for; so neither the number
of files nor, with `keep`, that of keys grows without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.sources import snapshots

BUCKETS = 16


def _keys(spark: SparkSession, state: str, schema: str, number: int, keep: int | None) -> DataFrame:
    """(key, seen) of the batches before a number."""
    compact = snapshots.read(spark, f"{state}/compact")
    done = None if compact is None else compact.agg(F.max("upto")).first()[0]
    done = -1 if done is None else done
    rows = spark.createDataFrame([], schema) if compact is None else compact.select("key", "seen")
    for n in range(max(0, done + 1), number):
        rows = rows.unionAll(spark.read.schema(schema).parquet(f"{state}/batch={n}"))
    rows = rows.where(F.col("seen") < number)
    return rows if keep is None else rows.where(F.col("seen") >= number - keep)


def first_seen(batch: DataFrame, number: int, existing: DataFrame, key: str, out: str, state: str, keep: int | None = None) -> None:
    """Write under a batch's number its rows, one for each key, that neither existing nor an earlier batch has, and their keys.

    Of several rows with a key the least stays. Rows with a null key are left out.
    """
    spark = batch.sparkSession
    own = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*batch.columns)).alias("_r"))
    fresh = own.join(existing.select(F.col(key).alias("_key")), "_key", "left_anti")
    schema = f"key {batch.schema[key].dataType.simpleString()}, seen long"
    seen = _keys(spark, state, schema, number, keep)
    met = seen.join(fresh.select(F.col("_key").alias("key")), "key", "left_semi").select(F.col("key").alias("_key"))
    fresh.join(met, "_key", "left_anti").select("_r.*").write.mode("overwrite").parquet(f"{out}/batch={number}")
    # The keys come from the written rows, so both have the same ones.
    rows = spark.read.schema(batch.schema).parquet(f"{out}/batch={number}")
    rows.select(F.col(key).alias("key"), F.lit(number).cast("long").alias("seen")).write.mode("overwrite").parquet(f"{state}/batch={number}")


def compact(spark: SparkSession, number: int, kind: str, state: str, keep: int | None = None, buckets: int = BUCKETS) -> None:
    """Publish the keys of all batches before a number as one snapshot."""
    rows = _keys(spark, state, f"key {kind}, seen long", number, keep)
    snapshots.publish(rows.withColumn("upto", F.lit(number - 1).cast("long")).repartition(buckets, "key").sortWithinPartitions("key"), f"{state}/compact")


def first_seen_stream(stream: DataFrame, existing: DataFrame, key: str, out: str, state: str, checkpoint: str, keep: int | None = None, every: int = 20, available_now: bool = True) -> StreamingQuery:
    """Append to `out`, under the batches' numbers, the rows of a stream whose key is new."""
    spark, kind = stream.sparkSession, stream.schema[key].dataType.simpleString()

    def write(batch: DataFrame, number: int) -> None:
        if number and number % every == 0:
            compact(spark, number, kind, state, keep)
        first_seen(batch, number, existing, key, out, state, keep)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
