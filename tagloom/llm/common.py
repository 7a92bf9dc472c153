"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a task turns into Python objects at once.
SLICE_ROWS = 512
#: Bytes of text of such a slice; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir; only a run in one local process sets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tagloom-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that a task takes at least.
FEW_ROWS = 500_000
LEAST_PARTS = 12


def parts_for(rows: int) -> int:
    """Partitions for so many rows of a few numbers: not all that a session shuffles to, where the rows would be few in each."""
    return max(LEAST_PARTS, -(-rows // FEW_ROWS))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few rows and few bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int, max_chars: int) -> DataFrame:
    """Labelled rows outside the held-out fold as (doc_id, text, y), smallest id hash first, one row for an id.

    At most `limit` ids are taken, and of these, in the same order, those whose texts have `max_chars` characters together
    (the first one in any case); every text taken is whole. The chosen ids and labels are rows of 20 bytes, at most
    `limit` of them, so the side joined to the documents is broadcast with that bound. Rows with a null id or label are
    left out, an id with several labels counts with the largest, one with several texts with the smallest.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = checkpoint(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    # At most `limit` rows of an id and a number go through this window.
    before = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = one.select("doc_id", F.length("text").alias("_n")).select("doc_id", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    taken = upto.where((F.col("_before") == 0) | (F.col("_before") + F.col("_n") <= max_chars)).select("doc_id")
    return one.join(F.broadcast(taken), "doc_id", "left_semi")
