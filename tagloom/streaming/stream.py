"""Streams over a growing folder of records: incremental curation and running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.sources import snapshots


def curate_stream(stream: DataFrame, curate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """H1: run a stateless curation on every new batch of records and append it, each batch once.

    A batch is written under its number, so one that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        curate(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, key: str = "tag") -> DataFrame:
    """H3: counts per key so far, for output mode complete."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def replace(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest whole result of a stream as a snapshot; readers see the one before until the next is complete."""

    def write(batch: DataFrame, number: int) -> None:
        snapshots.publish(batch, out)

    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
