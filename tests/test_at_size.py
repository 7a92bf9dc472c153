"""What only larger or odd tables show: queries against their SQL, and the work that steps do."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.operators import captions, classify, fill, quota, rules
from tagloom.plans import layouts, lookups, registry
from tagloom.sources import index


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables given as DuckDB SQL."""
    con = duckdb.connect()
    for t, text in tables.items():
        con.execute(f"COPY ({text}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    mine = registry.QUERIES[name](spark, str(folder))
    theirs = con.execute(registry.ORACLE[name])
    names = [d[0] for d in theirs.description]
    return sorted(tuple(r[n] for n in names) for r in mine.collect()), sorted(theirs.fetchall())


@pytest.mark.parametrize("views", [0, 1_000_003])
def test_progress_past_the_total(spark, tmp_path, views):
    got, want = both(spark, tmp_path, "e18_progress_report", events=f"SELECT CASE WHEN i < {views} THEN 'view' ELSE 'click' END AS event_type, 0.5::DOUBLE AS value FROM range({views + 2}) t(i)")
    assert got == want
    assert got[0][-1] == 0 and got[0][0] == views


def test_repeated_sentence_within_the_scan_limit(spark, tmp_path):
    # The third copies of the first text's sentence end after 200,000 characters, those of the second before.
    texts = "SELECT 10 AS doc_id, repeat('one two three four five six seven eight ', 1750) AS text UNION ALL SELECT 20, repeat('one two three four five six seven eight ', 1600)"
    got, want = both(spark, tmp_path, "f2_repeated_sentence", documents=texts)
    assert got == want == [(20,)]


@pytest.mark.parametrize("name", ["g2_layout_violations", "g3_box_to_pixels", "g4_center_boxes"])
def test_layouts_use_all_cores_and_read_a_number_once(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    # Four groups and a test of each number, and the same of the exponent, in each of the branches.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 20 + 40 * (name == "g2_layout_violations")


def test_scores_meet_once_and_by_record(spark, data):
    plan = registry.QUERIES["c19_select_predicted"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not re.search(r"Join \[record_id#\w+, label#", plan)


def test_combinations_in_the_row_equal_joins(spark):
    rt = spark.createDataFrame([(i, t) for i, ts in enumerate(["ab", "abb", "abc", "c", "", "b", "bd"]) for t in ts], "record_id int, tag string")
    made = spark.createDataFrame([("x", ["a", "b"], ["c"], "n"), ("y", ["b"], None, None), ("z", [], ["a"], "none"), ("w", ["b", None], [], "null"), ("v", ["d", "d"], [None], "twice"), (None, ["a"], [], "nameless")], "rule string, all_of array<string>, none_of array<string>, note string")
    rows = lambda small: sorted(map(tuple, rules.combination_rules(rt, made, small).collect()), key=repr)
    assert rows(None) == rows(0) == sorted([(0, "x", "n"), (1, "x", "n"), (0, "y", None), (1, "y", None), (2, "y", None), (5, "y", None), (6, "y", None), (6, "v", "twice")], key=repr)


def test_combinations_shuffle_by_record_alone(spark, data):
    plan = registry.QUERIES["c26_combination_rules"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fired_rules_do_not_meet_by_tag(spark, data):
    plan = registry.QUERIES["c5_fired_rules"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan


def test_fired_rules_by_filter_equal_joins(spark):
    rt = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a"), (None, "b")], "record_id int, tag string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None), (None, "b")], "remove string, present string")
    rows = lambda small: sorted(map(tuple, rules.fired_rules(rt, pairs, small).collect()), key=repr)
    assert rows(None) == rows(0) == sorted([(1, "a", "b"), (1, "b", "a"), (None, "a", "b"), (None, "b", "a")], key=repr)


def test_posts_are_read_once_for_their_md5(spark):
    p = spark.createDataFrame([("one", i, f"{i // 2 if i < 4 else i:032x}", "g", 1.0, ["x"]) for i in range(6)], "source string, id long, md5 string, rating string, score double, tags array<string>")
    df = fill.candidate_posts(p)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in df.where("alone").collect()) == [4, 5]


def test_levels_cut_what_cannot_be_taken(spark):
    scores = [float("nan"), float("inf"), 7.0, 7.0, 5.0, 0.0, -0.0, -2.0, float("-inf"), None]
    edges = spark.createDataFrame([(gap, float(s) if s is not None else None, i != 2) for gap in (1, 3, 4, 20) for i, s in enumerate(scores)], "seq int, score double, alone boolean")
    requests = spark.createDataFrame([(g, g) for g in (1, 3, 4, 20)], "seq int, gap int")
    kept = edges.join(fill.lowest_levels(edges, requests), "seq").where(F.col("_cut").isNull() | (fill.level() > F.col("_cut")))
    assert {r["seq"]: r["count"] for r in kept.groupBy("seq").count().collect()} == {1: 1, 3: 4, 4: 5, 20: 10}


def test_small_buckets_share_tasks(spark, tmp_path):
    rt = spark.range(3000).selectExpr("id AS record_id", "'f' AS folder", "concat('t', id % 50) AS tag")
    store = spark.sparkContext._jsc.sc().statusStore()
    index.write_index(rt, str(tmp_path / "i"), 20)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    newest = max((stages.apply(i) for i in range(stages.size())), key=lambda s: s.stageId())
    assert newest.numTasks() == 4
    files = [f.parent.name for f in (tmp_path / "i" / "rows").rglob("*.parquet")]
    assert len(files) == len(set(files)) > 80
    assert sorted(map(tuple, index.lookup(spark, str(tmp_path / "i"), ["t7", "none"]).collect())) == [("t7", "f", i) for i in range(7, 3000, 50)]


@pytest.mark.parametrize("name", ["a0c_read_source_tags", "a0d_read_source_metadata", "a0f_read_dataset_tags"])
def test_tag_texts_use_all_cores(spark, data, name):
    assert registry.QUERIES[name](spark, data).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_first_seen_files_are_many_and_batches_four(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(layouts, "scratch", lambda spark: str(tmp_path / "s"))
    assert registry.QUERIES["h2_first_seen"](spark, data).count() > 0
    assert len(list((tmp_path / "s").glob("*.parquet"))) >= 2 * spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "s-out").glob("batch=*"))) == 4


def test_caption_files_are_many(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(lookups, "scratch", lambda spark: str(tmp_path / "c"))
    files = lookups.captions_in_files(spark, data).where("caption <> '7'").select("_file").distinct().count()
    assert files >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["c9_split_by_membership", "c11_assemble_tags", "c14_classify_tags", "c14_rejects", "c17_group_post_tags", "c20_append_missing"])
def test_tags_are_gathered_once_by_record(spark, data, name):
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*tag#", plan.replace("_tag#", ""))
    assert "collect_list(struct(pos" not in plan


def test_classes_in_the_row_equal_joins(spark):
    lists = ["a", "b c", "b_c", "B c ", "hot", "x quality", "Safe", "old", "zz", "q", None]
    rt = spark.createDataFrame([(i, p, t) for i in range(4) for p, t in enumerate(lists[i:] + lists[:3])] + [(5, 0, None)], "record_id int, pos int, tag string")
    cats = spark.createDataFrame([("a", 0), ("b c", 1), ("hot", 5), ("q", 9), ("old", 4)], "tag string, category int")
    known = spark.createDataFrame([(0, " HOT", 1), (0, "zz", 7), (1, "a", 4), (1, "a", 3), (2, "safe", 1)], "record_id int, tag string, category int")
    rows = lambda k, small: sorted(map(tuple, classify.classes(rt, cats, k, small).collect()), key=repr)
    assert rows(None, None) == rows(None, 0)
    assert rows(known, None) == rows(known, 0)
    got = {r[0]: r for r in rows(known, None)}
    assert got[0][1:] == (["x quality"], ["Safe"], ["old"], ["a"], ["b c", "hot"], [], [], [], ["q", "zz"])
    assert got[5][1:] == ([],) * 9


def test_post_tags_in_the_row_equal_joins(spark):
    posts = spark.createDataFrame([(1, ["b", "a", None]), (1, ["a", "z"]), (2, ["q"]), (3, []), (4, None), (5, [None])], "id int, tags array<string>")
    cats = spark.createDataFrame([("a", 0), ("a", 4), ("b", 1), ("b", 1), ("q", 9), (None, 3)], "tag string, category int")
    rows = lambda small: sorted(map(tuple, classify.group_post_tags(posts, cats, small).collect()), key=repr)
    assert rows(None) == rows(0) == [(1, ["a", "z"], ["b"], [], ["a"], []), (2, [], [], [], [], []), (5, [], [], [], [], [])]


def test_identities_are_dealt_out_once(spark):
    rt = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "safe"), ("a", "explicit"), ("b", "x"), ("b", "f"), ("b", None), ("c", None), (None, "x")], "identity string, tag string")
    df = quota.quota_snapshot(rt, "f")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = {tuple(r) for r in df.collect()}
    assert {r for r in rows if r[0] == "x"} == {("x", None, None, 2), ("x", "e", None, 1), ("x", None, True, 1)}
    assert {r for r in rows if r[0] is None} == {(None, None, None, 2), (None, None, True, 1)}


def test_loops_by_every_seventh_place_equal_all_places(spark):
    """Every width, run length and place of a run, against the rule in plain Python."""

    def loops(ws):
        for w in range(1, 9):
            need, run = max(5, -(-24 // w)) * w - 1, 0
            for i in range(w, len(ws)):
                run = run + 1 if ws[i] == ws[i - w] else 0
                if run >= need:
                    return len(ws) >= 24
        return False

    rows = []
    for w in range(1, 9):
        for n in (max(5, -(-24 // w)) * w + d for d in (-1, 0, 1)):
            for before in range(9):
                rows.append([f"x{i}" for i in range(before)] + [f"p{i % w}" for i in range(n)] + [f"y{i}" for i in range(3)])
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "i int, text string").select("i", captions.phrase_loop(F.col("text")).alias("looping"))
    assert {r.i: r.looping for r in df.collect()} == {i: loops(r) for i, r in enumerate(rows)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sequence(7") == 8


def test_short_sentences_do_not_run_away(spark):
    texts = [" ".join("a" * n) + ". b" for n in (39, 40, 41, 42)] + ["", None, "a " * 30 + "_b" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", captions.runaway(F.col("text"), 40).alias("r"), (T.longest_sentence(F.col("text")) > 40).alias("plain")).collect()
    assert [r.r for r in got] == [r.plain for r in got] == [False, False, True, True, False, False, False]


def test_only_texts_that_need_python_go_there(spark):
    texts = [None, "", "plain END_CAPTION", "e\u0301 \u212b", "\uac00\u11a8", "x &lt;&eacute;", "End_Caption", "a < b", "<THINK>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select(T.nfc(F.col("text")).alias("n"), T.unescape(F.col("text")).alias("u"), T.control_marker(F.col("text")).alias("m"))
    assert "ArrowEvalPython" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "[^" in plan
    rows = got.collect()
    import html
    import unicodedata

    assert [r.n for r in rows] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert [r.u for r in rows] == [t and html.unescape(t) for t in texts]
    assert [r.m for r in rows] == [None, "", "END_CAPTION", "", "", "", "End_Caption", "", "<THINK>"]
