"""Snapshots, the tag index, keys over a long stream, and files of differing schemas."""

import time

import pytest
from pyspark.sql import functions as F

from tagloom.operators import lookup
from tagloom.sources import index, io, snapshots
from tagloom.streaming import first_seen


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_snapshots_publish_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, "k int, v string")
    assert snapshots.read(spark, path) is None and snapshots.current(spark, path) == (0, [])
    assert snapshots.upsert_into(path, make([(1, "a"), (2, " ")]), ["k"], "ignore") == 1
    assert snapshots.upsert_into(path, make([(1, "b"), (2, "c"), (3, "d")]), ["k"], "fill_blank") == 2
    assert rows(snapshots.read(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(snapshots.read(spark, path, 1)) == [(1, "a"), (2, " ")]
    # A write that fails half way leaves the version; its data is no part of the table.
    broken = make([(1, "x")]).select("k", F.expr("raise_error('stop')").cast("string").alias("v"))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(broken, path)
    assert snapshots.current(spark, path)[0] == 2 and rows(snapshots.read(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]
    # Data without a row in the manifest neither.
    make([(9, "z")]).write.parquet(f"{path}/data/stray")
    assert rows(snapshots.read(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "k int")
    snapshots.publish(df, path)
    base = snapshots.current(spark, path)
    assert snapshots.publish(df, path, base) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(df, path, base)
    # Both rows in the manifest at once: the smaller token has the version. A row that comes later changes nothing.
    spark.createDataFrame([(3, 2, "b", ["data/mine"]), (3, 2, "c", ["data/other"])], snapshots.MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    assert snapshots.current(spark, path) == (3, ["data/mine"])
    time.sleep(1.1)
    spark.createDataFrame([(3, 2, "a", ["data/late"])], snapshots.MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    assert snapshots.current(spark, path) == (3, ["data/mine"])


def test_create_missing_adds_only(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, "record_id int, v string")
    snapshots.create_missing(path, make([(1, "a"), (1, "b")]))
    snapshots.create_missing(path, make([(1, "c"), (2, "d")]))
    assert rows(snapshots.read(spark, path)) == [(1, "a"), (2, "d")]
    assert len(snapshots.current(spark, path)[1]) == 2
    snapshots.create_missing(path, make([]))
    assert rows(snapshots.read(spark, path)) == [(1, "a"), (2, "d")]


def test_index_lookup_reads_its_buckets(spark, tmp_path):
    rt = spark.range(4000).select(F.col("id").alias("record_id"), F.lit("f").alias("folder"), F.when(F.col("id") % 4 < 3, "common").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("tag"))
    path = str(tmp_path / "i")
    index.write_index(rt.unionAll(rt.limit(100)), path, 500)
    assert rows(index.lookup(spark, path, ["common"])) == rows(rt.where("tag = 'common'").select("tag", "folder", "record_id"))
    assert rows(index.lookup(spark, path, ["t3", "nothing"])) == rows(rt.where("tag = 't3'").select("tag", "folder", "record_id"))
    files = lambda tags: len({r[0] for r in index.lookup(spark, path, tags).select(F.input_file_name()).collect()})
    assert files(["t3"]) == 1 and files(["common"]) == 6 and len(index.buckets_of(spark, path, ["common"])) == 6
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("bucket").count().collect()]
    assert max(sizes) <= 1200
    index.write_index(rt.limit(0), str(tmp_path / "e"))
    assert spark.read.parquet(f"{tmp_path}/e/buckets").first().buckets == 1


def batches(spark, path, groups):
    for g in groups:
        spark.createDataFrame(g, "key string, n int").coalesce(1).write.mode("append").parquet(path)


def test_first_seen_over_many_batches(spark, tmp_path):
    groups = [[("a", 1), ("a", 0), ("x", 1)], [("b", 2), ("a", 2), (None, 2)], [("c", 3), ("b", 3)], [("a", 4), ("d", 4)], [("d", 5)], [("e", 6), ("c", 6)]]
    batches(spark, str(tmp_path / "in"), groups)
    stream = spark.readStream.schema("key string, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    old = spark.createDataFrame([("x",)], "key string")
    first_seen.first_seen_stream(stream, old, "key", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), every=2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "n")
    assert sorted(r.key for r in got.collect()) == ["a", "b", "c", "d", "e"]
    # The state holds each key once, in as many files as buckets after it was put together.
    state = snapshots.read(spark, str(tmp_path / "state" / "compact"))
    assert state.count() == state.select("key").distinct().count() and len(state.inputFiles()) <= first_seen.BUCKETS


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    df = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "key string, n int")
    none = df().select("key")
    for number, keys in ((0, "ab"), (1, "bc"), (1, "bc"), (2, "cd"), (2, "cd")):
        if number == 2:
            first_seen.compact(spark, 2, "string", state)
        first_seen.first_seen(df(*keys), number, none, "key", out, state)
    assert sorted((r.key, r.batch) for r in spark.read.parquet(out).collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_keys_expire_where_asked(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    none = spark.createDataFrame([], "key string")
    for number, key in enumerate("abcda"):
        first_seen.first_seen(spark.createDataFrame([(key,)], "key string"), number, none, "key", out, state, keep=2)
        first_seen.compact(spark, number + 1, "string", state, keep=2)
        assert snapshots.read(spark, f"{state}/compact").count() <= 2
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "a", "b", "c", "d"]


def test_files_of_other_schemas_are_left_out(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.createDataFrame([("A ", "first", 1), ("b", "\t", 2)], "md5 string, caption string, more int").coalesce(1).write.parquet(path)
    spark.createDataFrame([("c", 1)], "md5 string, other int").coalesce(1).write.mode("append").parquet(path)
    found = lookup.lookup_captions(io.read_lookup_files(spark, path, "md5 string, caption string"))
    assert rows(found) == [("a", "first")]
    spark.createDataFrame([("d", 5)], "md5 string, caption int").coalesce(1).write.mode("append").parquet(path)
    found = lookup.lookup_captions(io.read_lookup_files(spark, path, "md5 string, caption string"))
    assert rows(found) == [("a", "first")]
    (tmp_path / "none").mkdir()
    assert io.read_lookup_files(spark, str(tmp_path / "none"), "md5 string").collect() == []


def test_lookup_order_is_file_then_row(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.range(40).select(F.lit("k").alias("md5"), F.when(F.col("id") < 7, " ").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("caption"), "id")
    df.repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    assert rows(lookup.lookup_captions(io.read_lookup_files(spark, path, "md5 string, caption string"))) == [("k", "c7")]
