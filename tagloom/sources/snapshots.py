"""Keyed tables as versioned snapshots in a folder, written by Spark alone.

A snapshot is a list of data folders. Data is written to a new folder first, and only then one row to the manifest, a small table
beside the data: (version, parent, token, folders). Readers follow the manifest's last version, so a write that fails or is
still going on leaves the old one as it was, and its data is never read. Of two writers that start from one version, the one whose
row came first has the next (by the time of the manifest's file, then by the token); the other sees that and raises `Conflict`.
Older versions stay readable.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources import io

MANIFEST = "version long, parent long, token string, folders array<string>"


class Conflict(RuntimeError):
    """Another writer has published the version first."""


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count: of each version the first one whose parent is the version before."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    rows = rows.where("parent = version - 1").select("*", F.col("_metadata.file_modification_time").alias("at"))
    return rows.groupBy("version").agg(F.min(F.struct("at", "token", "folders")).alias("m")).select("version", "m.token", "m.folders")


def current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last version and its data folders; (0, []) where nothing is published."""
    last = _manifest(spark, path).orderBy(F.desc("version")).limit(1).collect()
    return (last[0].version, list(last[0].folders)) if last else (0, [])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, by default the last; None where nothing is published."""
    if version is None:
        version, folders = current(spark, path)
    else:
        folders = [f for r in _manifest(spark, path).where(F.col("version") == version).collect() for f in r.folders]
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def publish(df: DataFrame, path: str, base: tuple[int, list[str]] | None = None, add: bool = False) -> int:
    """Write df as the next version after base (by default the current one) and return its number.

    With `add`, df is added to base's rows, whose data isn't written again. Raises Conflict if base is no longer the last
    version, which leaves the other writer's version in place.
    """
    spark = df.sparkSession
    version, folders = current(spark, path) if base is None else base
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    if current(spark, path)[0] != version:
        raise Conflict(f"version {version} of {path} is no longer the last one")
    token = uuid.uuid4().hex
    row = [(version + 1, version, token, ([*folders, folder] if add else [folder]))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    if not _manifest(spark, path).where((F.col("version") == version + 1) & (F.col("token") == token)).count():
        raise Conflict(f"another writer published version {version + 1} of {path}")
    return version + 1


def upsert_into(path: str, new: DataFrame, keys: list[str], mode: str) -> int:
    """A0m: publish the table after writing new over it: replace, ignore, or fill_blank. The first write creates it."""
    spark = new.sparkSession
    base = current(spark, path)
    old = read(spark, path, base[0]) if base[0] else None
    return publish(new if old is None else io.upsert(old, new, keys, mode), path, base)


def create_missing(path: str, new: DataFrame, key: str = "record_id") -> int:
    """A0l: add the rows of new whose key the table lacks, one for each key (the least row); what is there isn't written again."""
    spark = new.sparkSession
    base = current(spark, path)
    one = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("_r")).select(key, "_r.*") if len(new.columns) > 1 else new.distinct()
    one = one.select(*new.columns)
    old = read(spark, path, base[0]) if base[0] else None
    return publish(one if old is None else io.write_missing(one, old, key), path, base, add=True)
