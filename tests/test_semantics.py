"""Hand-made cases of the rules that are easy to get wrong."""

import hashlib

from pyspark.sql import functions as F

from tagloom.functions import norm
from tagloom.functions import text as T
from tagloom.operators import captions, gate, layout, lookup, quota, rules
from tagloom.sources import snapshots
from tagloom.streaming import stream


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_rules_are_one_pass(spark):
    rt = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")], "record_id int, pos int, tag string")
    mutual = spark.createDataFrame([("a", "b"), ("b", "a")], "remove string, present string")
    assert rules.apply_rules(rt.where("record_id = 1"), mutual)[0].count() == 0
    chain = spark.createDataFrame([("a", "b"), ("c", "a")], "remove string, present string")
    kept, fired = rules.apply_rules(rt.where("record_id = 2"), chain)
    assert [r.tag for r in kept.collect()] == ["b"]
    assert fired.count() == 2


def test_cleaning_twice_changes_nothing(spark):
    records = spark.createDataFrame([(1, "Red_hat, red hat, ,blue"), (2, ""), (3, None)], "record_id int, tags string")
    none = lambda schema: spark.createDataFrame([], schema)
    args = (none("old string, new string"), none("tag string"), none("fragment string"), none("remove string, present string"))
    once = rules.clean_tags(records, "tags", *args)
    assert {r.record_id: r.tags for r in once.collect()} == {1: ["red hat", "blue"], 2: [], 3: []}
    again = rules.clean_tags(once.select("record_id", F.array_join("tags", ", ").alias("tags")), "tags", *args)
    assert sorted(map(tuple, ((r.record_id, *r.tags) for r in again.collect()))) == sorted(map(tuple, ((r.record_id, *r.tags) for r in once.collect())))


def test_quality_labels(spark):
    cases = [("131", "g", "masterpiece"), ("130", "g", "best quality"), ("3", "s", "low quality"), ("3.9", "g", "low quality"), ("4", "g", "normal quality"), ("-1", "g", "worst quality"), ("-1.5", "g", "worst quality"), ("-0.5", "g", "low quality"), ("x", "g", ""), ("NaN", "g", ""), ("inf", "g", ""), ("231", "e", "masterpiece"), ("230", None, "best quality"), (None, "g", "")]
    df = spark.createDataFrame(cases, "score string, rating string, want string")
    assert df.where(norm.quality_tag(F.col("score"), F.col("rating")) != F.col("want")).collect() == []


def test_years_stay_in_their_own_offset(spark):
    for text, period, year in (("2021-01-01T00:30:00+05:00", "newest", "year 2021"), ("2020-12-31T23:30:00-05:00", "recent", "year 2020"), ("Sat Jan 02 10:00:00 +0000 2021", "", "year 2021"), ("", "", ""), ("soon", "", "")):
        assert _one(spark, norm.period_tag(F.lit(text))) == period
        assert _one(spark, norm.year_tag(F.lit(text))) == year


def test_phrase_loops(spark):
    pair = ["a b"] * 12
    for text, want in ((" ".join(["na"] * 24), True), (" ".join(["na"] * 23), False), (" ".join([*pair, "a"]), True), (" ".join(pair), False), ('"' + "na " * 40 + '"', False), ("", False)):
        assert _one(spark, captions.phrase_loop(F.lit(text))) is want


def test_repeated_sentences(spark):
    s = "One two three four five six seven eight."
    rows = [(1, " ".join([s] * 3)), (2, " ".join([s] * 3) + " " + " ".join(f"w{i}" for i in range(60))), (3, " ".join(f'"{s}"' for _ in range(3))), (4, " ".join([s] * 2)), (5, None)]
    df = spark.createDataFrame(rows, "record_id int, text string")
    assert [r.record_id for r in captions.repeated_sentence(df, ["record_id"]).collect()] == [1]


def test_reasoning_blocks(spark):
    for text, want in (("&lt;think&gt;x&lt;/think &gt;b {c}", "b c"), ("a\\<think\\>b", "a"), ("a\n \\## \nb", "a\n\nb"), ("&copy;&#33;", "©!"), ("a<think>b<think>c</think>d</think>e", "ae"), ("a<think>b", "a"), ("</think>a", "a"), ("a</think>b", "ab")):
        assert _one(spark, T.strip_reasoning(F.lit(text))) == want


def test_output_is_cleaned_line_by_line(spark):
    for text, want in (
        ("<format>\n> a\n > b\n</format>", "a b"),
        ("a <format> b", "a <format> b"),
        ("# Long caption:\nSo it is", "So it is"),
        ("Caption: so it is", "Caption: so it is"),
        ('"a" and "b"', 'a" and "b'),
        ('"', '"'),
        ("e\u0301END_CAPTION x", "é"),
    ):
        assert _one(spark, T.clean_output(F.lit(text))) == want


def test_credits(spark):
    names = F.array(F.lit("J. Doe"), F.lit("@x"))
    for text, bare, known in (
        ("Drawn by @a, @b. A tree.", "A tree.", "A tree."),
        ("drawn by J. Doe. A tree.", "drawn by J. Doe. A tree.", "A tree."),
        ("Drawn by J. Doe, x. Drawn by @q.z. A", "Drawn by J. Doe, x. Drawn by @q.z. A", "A"),
        ("Drawn by two horses. A", "Drawn by two horses. A", "Drawn by two horses. A"),
        ("Drawn by @. A", "Drawn by @. A", "Drawn by @. A"),
        ("Drawn by @a.", "", ""),
    ):
        assert _one(spark, T.strip_credit(F.lit(text))) == bare
        assert _one(spark, T.strip_credit(F.lit(text), names)) == known
    assert _one(spark, T.set_credit(F.lit("Drawn by x. A"), names)) == "Drawn by @J. Doe, @x. A"
    assert _one(spark, T.set_credit(F.lit("Drawn by @x. A"), F.array(F.lit(" ")))) == "Drawn by @x. A"


def test_wiki_text(spark):
    for text, want in (("a [[b|c]] [[d]] [i]e[/i] [f]\n!g\nh", "a c d e h"), ("a h4. Appearance b H4. COSTUMES c", "a h4. Appearance b"), ("", "")):
        assert _one(spark, T.clean_wiki(F.lit(text))) == want


def test_prompts_that_differ_have_different_keys(spark):
    p = lambda text: lookup.canonical_prompt(F.lit(text), ("# A",), (("<<", ">>"),))
    assert _one(spark, p("x\r\n# A\n\n \n\ny\n\nz<< Drawn by @a. b >>")) == "x\n# A\n\ny\n\nz<<b>>"
    assert _one(spark, p("credit: one\n<<a>> then")) == "credit: one\n<<a>> then"
    keys = [_one(spark, lookup.cache_key(F.lit("00ff"), F.lit(k).cast("string"), F.lit(m).cast("string"), F.lit("p"))) for k, m in ((None, "x"), ("x", None), ("x", "y"), ("xy", ""))]
    assert keys[:2] == [None, None]
    assert keys[2] == hashlib.sha256(bytes.fromhex("00ff") + b"\0x\0y\0p").hexdigest()
    assert keys[2] != keys[3]


def test_streams_in_several_batches(spark, tmp_path):
    """Records in four files, one for each batch: routed, first seen and counted as if they had come at once."""
    d = spark.range(40).select(F.col("id").alias("record_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("tag"), (F.col("id") % 4).alias("f"))
    for k in range(4):
        d.where(F.col("f") == k).drop("f").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    records = lambda: spark.readStream.schema("record_id long, tag string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.curate_stream(records(), lambda b: b.where("record_id % 2 = 0"), str(tmp_path / "a"), str(tmp_path / "ac")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).select("record_id").distinct().count() == 20
    assert len(list((tmp_path / "a").glob("batch=*"))) == 4
    stream.replace(stream.running_counts(records()), str(tmp_path / "c"), str(tmp_path / "cc")).awaitTermination()
    assert {r.tag: r.n for r in snapshots.read(spark, str(tmp_path / "c")).collect()} == {f"t{k}": 6 if k < 5 else 5 for k in range(7)}


def test_words_next_to_underscores(spark):
    assert _one(spark, T.words(F.lit("foo_bar ab-cd x_y don’t ß9"))) == ["ab-cd", "don’t", "ß9"]


def test_snapshot_takes_the_strictest_stratum_once(spark):
    rt = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "safe"), ("p", "explicit"), ("q", "x")], "identity string, tag string")
    rows = {(r.tag, r.stratum, r.flag): r.n for r in quota.quota_snapshot(rt, "official art").collect()}
    assert rows["x", None, None] == 2
    assert rows["x", "e", None] == 1
    assert ("x", "g", None) not in rows


def test_requests_merge_by_words(spark):
    old = spark.createDataFrame([("one", "a b", 3, True), ("one", "c", 4, False)], "source string, tags string, target int, owned boolean")
    new = spark.createDataFrame([("one", "b  A", 9), ("one", "c", 9), ("one", "d", 9)], "source string, tags string, target int")
    rows = {r.identity: (r.target, r.action) for r in quota.merge_requests(old, new).collect()}
    assert rows == {"a b": (9, "refresh"), "c": (4, "keep"), "d": (9, "insert")}


def test_boxes(spark):
    rows = [
        ([0.0, 0.0, 10.0, 10.0], 10, 10, "abs", "xyxy", None, None, (True, 0, 0, 10, 10)),
        ([5.0, 0.0, 5.0, 10.0], 10, 10, "abs", "xyxy", None, None, (False, None, None, None, None)),
        ([0.0, 0.0, 11.0, 10.0], 10, 10, "abs", "xyxy", None, None, (False, None, None, None, None)),
        ([0.25, 0.5, 2.25, 3.5], 10, 10, "abs", "yxyx", None, None, (True, 0, 0, 4, 3)),
        ([-5.5, -5.5, 5.5, 0.0], 11, 11, "abs_centralized", "xyxy", None, None, (True, 0, 0, 11, 6)),
        ([1.0, 1.0, 2.0, 2.0], 10, 10, "abs", "xyxy", 3, 3, (True, 3, 3, 7, 7)),
    ]
    df = spark.createDataFrame([r[:7] for r in rows], "box array<double>, width int, height int, space string, format string, preview_w int, preview_h int")
    df = df.withColumn("box", F.col("box").cast("array<decimal(20,6)>"))
    got = [tuple(r) for r in layout.box_to_pixels(df).select("valid", "x1", "y1", "x2", "y2").collect()]
    assert got == [r[7] for r in rows]


def test_repeated_json_keys_are_rejected(spark):
    df = spark.createDataFrame([(1, '{"items": [], "items": []}'), (2, '{"items": [{"bbox": [Infinity]}]}'), (3, None), (4, '{"items": []}')], "record_id int, layout string")
    good, bad = layout.parse_layouts(df)
    assert [r.record_id for r in good.collect()] == [4]
    assert bad.count() == 3


def test_gate_always_blocks(spark):
    rt = spark.createDataFrame([(1, "f", 0, "Tag"), (2, "f", 0, gate.ALWAYS_BLOCKED[0].upper()), (3, "f", 0, "A&amp;B")], "record_id int, folder string, pos int, tag string")
    assert {r.record_id for r in gate.exclude_blocked(rt)[0].collect()} == {1, 3}
    kept, rejects = gate.exclude_blocked(rt, spark.createDataFrame([("a&b",)], "tag string"))
    assert {r.record_id for r in kept.collect()} == {1}
    assert {r.record_id: r.matched for r in rejects.collect()}[3] == ["a&b"]


def test_tables_without_rows(spark):
    rt = spark.createDataFrame([], "record_id int, folder string, pos int, tag string")
    assert gate.exclude_blocked(rt)[0].count() == 0
    assert rules.collect_tags(rt).count() == 0
    assert captions.caption_issues(spark.createDataFrame([], "record_id int, text string")).count() == 0
