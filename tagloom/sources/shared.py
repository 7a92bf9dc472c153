"""The folder that the driver and all executors share, for written steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a run in one local process sets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tagloom-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def many(spark: SparkSession) -> int:
    """Parts for all cores, also where a table has few bytes or the text of a part is long."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to all cores: for a table of few bytes, thus read by few tasks, whose rows take long."""
    return df.repartition(many(df.sparkSession), *keys)
