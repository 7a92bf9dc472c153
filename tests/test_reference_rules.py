"""Hand-made cases of single rules, and the sequential form of what Spark does in rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import norm
from tagloom.functions import text as T
from tagloom.operators import assemble, classify, fill, gate, lookup, quota, rules, stats


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Quotas.


def plain_fill(requests, posts, existing):
    """Requests one after the other, posts one after the other."""
    taken, credit, out = set(existing), {}, []
    for r in sorted(requests, key=lambda r: r["seq"]):
        left = max(0, (r["gap"] or 0) - credit.get(r["seq"], 0))
        fits = lambda p, r=r: r["tag"] in p["tags"] and r["stratum"] in (None, p["rating"]) and (not r["flag"] or "official art" in p["tags"])
        mine = [p for p in posts if p["source"] == r["source"] and fits(p) and (r["min_score"] is None or p["score"] is not None and p["score"] >= r["min_score"])]
        for p in sorted(mine, key=lambda p: (p["score"] is None, -(p["score"] or 0), p["id"], p["md5"] or "")):
            if not left:
                break
            if p["md5"] is None or p["md5"].lower() in taken:
                continue
            taken.add(p["md5"].lower())
            left -= 1
            out.append((r["seq"], p["source"], p["id"], p["md5"].lower()))
            for q in requests:
                if q["seq"] > r["seq"] and q["tag"] in p["tags"] and q["stratum"] in (None, p["rating"]) and (not q["flag"] or "official art" in p["tags"]):
                    credit[q["seq"]] = credit.get(q["seq"], 0) + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_fill_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    md5 = [f"{i:032x}" for i in range(40)]
    posts = [
        {"source": rng.choice(["one", "two"]), "id": i, "md5": rng.choice([*md5, None, "bad"]) if rng.random() < 0.9 else md5[i % 40].upper(), "rating": rng.choice(["g", "e"]), "score": rng.choice([None, 1.0, 2.0, 3.0]), "tags": rng.sample(["x", "y", "z", "official art"], rng.randint(1, 4))}
        for i in range(1, 80)
    ]
    posts = [p for p in posts if p["md5"] != "bad"] + posts[:3]
    requests = [{"seq": s, "source": rng.choice(["one", "two"]), "tag": rng.choice("xyz"), "stratum": rng.choice([None, "g", "e"]), "flag": rng.choice([True, False, None]), "min_score": rng.choice([None, 2.0]), "gap": rng.choice([None, 0, 1, 3, 6])} for s in range(12)]
    existing = md5[:4]
    unique = {(p["source"], p["id"], (p["md5"] or "").lower()): p for p in posts}
    want = plain_fill(requests, list(unique.values()), existing)
    r = spark.createDataFrame(requests, "seq int, source string, tag string, stratum string, flag boolean, min_score double, gap int")
    p = spark.createDataFrame(posts, "source string, id long, md5 string, rating string, score double, tags array<string>")
    got = fill.fill_requests(r, p, spark.createDataFrame([(m.upper(),) for m in existing], "md5 string"))
    assert sorted((x.seq, x.source, x.id, x.md5) for x in got.collect()) == want
    assert want


def test_fill_counts_a_post_for_all_it_satisfies(spark):
    r = spark.createDataFrame([(1, "one", "x", None, False, None, 1), (2, "one", "y", None, False, None, 1), (3, "two", "y", "g", False, None, 2)], "seq int, source string, tag string, stratum string, flag boolean, min_score double, gap int")
    a, b, c = ("a" * 32, "b" * 32, "c" * 32)
    p = spark.createDataFrame([("one", 1, a, "g", 9.0, ["x", "y"]), ("one", 2, b, "g", 8.0, ["y"]), ("two", 3, a, "g", 9.0, ["y"]), ("two", 4, c, "g", 1.0, ["y"])], "source string, id long, md5 string, rating string, score double, tags array<string>")
    assert sorted((x.seq, x.id, x.rank) for x in fill.fill_requests(r, p).collect()) == [(1, 1, 1), (3, 4, 1)]
    assert fill.fill_requests(r.limit(0), p).collect() == [] == fill.fill_requests(r, p.limit(0)).collect()


def test_dedupe_without_id_and_md5(spark):
    rows = [(1, "a", "k"), (1, "b", "l"), (0, "m", "k"), (None, "m", "z"), (None, "", "same"), (None, "", "same"), (None, None, "same")]
    got = quota.dedupe_posts(spark.createDataFrame(rows, "id int, md5 string, kind string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", "k"), (None, "m", "z"), (None, "", "same"), (None, None, "same")], key=repr)


def test_underfilled_by_total_stratum_and_flag(spark):
    tags = spark.createDataFrame([("a",), ("b",), ("new",)], "tag string")
    counts = spark.createDataFrame([("a", None, None, 10), ("a", "g", None, 4), ("a", None, True, 2), ("b", None, None, 3), ("b", "g", True, 1)], "tag string, stratum string, flag boolean, n long")
    by = lambda **k: {r.tag: (r.current, r.missing, r.flag_target) for r in quota.underfilled(tags, counts, **k).collect()}
    assert by(total_target=5) == {"b": (3, None, 0), "new": (0, None, 0)}
    assert by(total_target=5, absent_only=True) == {"new": (0, None, 0)}
    assert by(targets={"g": 4}) == {"b": (3, {"g": 4}, 0), "new": (0, {"g": 4}, 0)}
    assert by(targets={"g": 4}, flag_target=2)["b"] == (3, {"g": 4}, 2)
    assert by(total_target=1, flag_target=3) == {"a": (10, None, 3), "b": (3, None, 3), "new": (0, None, 3)}


def test_percentages_of_an_empty_scope(spark):
    counts = spark.createDataFrame([("a", 1)], "tag string, images long")
    total = spark.createDataFrame([(0,)], "total long")
    assert stats.tag_stats(counts, counts.select("tag", F.lit(0).alias("category")), total).first().percent == 0


# Admission.


def test_gate_blocks_words_inside_tags(spark):
    w = gate.ALWAYS_BLOCKED[gate.ALWAYS_BLOCKED.index("animated")]
    tags = [w, w.upper(), f"x-{w}", f"{w}_(series)", f"very {w} thing", f"&quot;{w}&quot;", "age__regression", "aged-down"]
    free = [f"{w}x", f"un{w}", "plain tag", "", None]
    rows = spark.createDataFrame([(i, [t, "z"]) for i, t in enumerate(tags + free)], "record_id int, tags array<string>")
    kept, gone = gate.exclude_blocked_rows(rows)
    assert {r.record_id for r in gone.collect()} == set(range(len(tags)))
    assert {r.record_id for r in kept.collect()} == set(range(len(tags), len(tags + free)))
    assert {"minor", "child", "underage", "teen"} <= set(gate.ALWAYS_BLOCKED)
    long = rows.select("record_id", F.explode("tags").alias("tag"))
    assert {r.record_id for r in gate.exclude_blocked(long)[1].collect()} == set(range(len(tags)))
    assert {r.record_id for r in gate.exclude_blocked(long)[0].collect()} == set(range(len(tags), len(tags + free)))


def test_gate_is_the_same_in_rows_and_by_joins(spark):
    rows = spark.createDataFrame([(1, ["a&amp;b", "x"]), (2, ["Animated", "C_d"]), (3, ["x"]), (4, None), (5, []), (None, ["c d"])], "record_id int, tags array<string>")
    blocked = spark.createDataFrame([("A&B",), ("c d",), (None,)], "tag string")
    want = {1: ["a&b"], 2: ["animated", "c d"], None: ["c d"]}
    for small in (None, 0):
        kept, gone = gate.exclude_blocked_rows(rows, "tags", blocked, small=small)
        assert {r.record_id: r.matched for r in gone.collect()} == want
        assert {r.record_id for r in kept.collect()} == {3, 4, 5}
        left, out = gate.exclude_blocked(rows.select("record_id", F.explode("tags").alias("tag")), blocked, small=small)
        assert {r.record_id: r.matched for r in out.collect()} == want and {r.record_id for r in left.collect()} == {3}
    assert "Exchange" not in plan_of(gate.exclude_blocked_rows(rows, "tags", blocked)[0])


def test_cleaning_in_rows_equals_joins(spark):
    rng = random.Random(2)
    words = ["red", "blue", "hot", "crimson", "old one", "a b", "ring", "x_y"]
    records = spark.createDataFrame([(i, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(900, None)], "record_id int, tags string")
    pairs = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    args = (pairs([("red", "crimson"), ("X_y", "a b"), ("red", "zzz")], ("old", "new")), pairs([("hot",), (None,)], ("tag",)), pairs([("old",)], ("fragment",)), pairs([("crimson", "blue"), ("blue", "crimson"), ("ring", "nothing"), (None, "red")], ("remove", "present")))
    here = rules.clean_tags(records, "tags", *args)
    there = rules.clean_tags(records, "tags", *args, small=0)
    assert {r.record_id: r.tags for r in here.collect()} == {r.record_id: r.tags for r in there.collect()}
    assert "Exchange" not in plan_of(here) and "Exchange" in plan_of(there)


def test_fragments_by_parts_equal_contains(spark):
    rt = spark.createDataFrame([(1, 0, "red hat"), (1, 1, "hat"), (2, 0, "ha"), (2, 1, None), (3, 0, ""), (3, 1, "héat")], "record_id int, pos int, tag string")
    exact = spark.createDataFrame([("ha",)], "tag string")
    for fragments in ([], ["d h"], ["at", "zzzzzzzzzz", None, ""], ["hat", "é"]):
        f = spark.createDataFrame([(x,) for x in fragments], "fragment string")
        want = {(r, p) for r, p, t in map(tuple, rt.collect()) if t != "ha" and not any(x and t and x in t for x in fragments)}
        for small in (None, 0):
            assert {(r.record_id, r.pos) for r in rules.drop_ignored(rt, exact, f, small).collect()} == want


def test_fired_rules_once_and_by_record(spark):
    rt = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (None, "a"), (None, "b"), (3, None)], "record_id int, tag string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "z"), (None, "a")], "remove string, present string")
    kept, fired = rules.apply_rules(rt, pairs)
    assert sorted(map(tuple, fired.collect()), key=repr) == [(1, "a", "b"), (None, "a", "b")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "b"), (1, "b"), (2, "a"), (None, "b"), (3, None)], key=repr)


def test_first_spellings_stay_in_order(spark):
    a = F.array(*map(F.lit, ["B", "a", "b", " ", "A", "c_d", "C d"]))
    assert one(spark, norm.dedupe_ci(a)) == ["B", "a", "c d"]
    assert one(spark, norm.dedupe_ci(F.array().cast("array<string>"))) == []


# Classes.


def test_classes_meet_tags_by_key(spark):
    rt = spark.createDataFrame([(1, 0, r"Fox \(a\)"), (1, 1, "fox (a)"), (1, 2, "Hill"), (2, 0, "hill")], "record_id int, pos int, tag string")
    cats = spark.createDataFrame([("hill", 0)], "tag string, category int")
    known = spark.createDataFrame([(1, "fox_(a)", 4), (1, "hill", 1), (1, "Hill", 5)], "record_id int, tag string, category int")
    out = {r.record_id: r for r in classify.classes(rt, cats, known).collect()}
    assert out[1].character == [r"Fox \(a\)"] and out[1].meta == ["Hill"] and out[1].general == [] and out[1].unresolved == []
    assert out[2].general == ["hill"]


def test_predictions_leave_ratings_and_banned_out(spark):
    labels = spark.createDataFrame([("tag one", 0, None), ("safe", 9, None), ("name", 4, 2.0), ("bad tag", 0, 0.1)], "label string, category int, threshold double")
    scores = spark.createDataFrame([(1, "tag one", 0.6), (1, "safe", 0.99), (1, "name", 0.7), (1, "bad tag", 0.9), (2, "tag one", 0.6)], "record_id int, label string, score double")
    good, bad = classify.select_predicted(scores, labels, spark.createDataFrame([("Bad_Tag ",)], "label string"), {0: 0.5, 4: 0.7})
    assert sorted((r.record_id, r.rank, r.label) for r in good.collect()) == [(1, 1, "name"), (1, 2, "tag one")]
    assert [r.record_id for r in bad.collect()] == [2]


def test_variants_leave_by_key(spark):
    rt = spark.createDataFrame([(1, 0, "Surtr_(x)"), (1, 1, "laevatain (x)"), (2, 0, "surtr (x)"), (2, 1, "(x)")], "record_id int, pos int, tag string")
    pairs = spark.createDataFrame([("surtr (x)", "Laevatain_(X)")], "older string, newer string")
    assert sorted((r.record_id, r.tag) for r in assemble.select_variants(rt, pairs).collect()) == [(1, "laevatain (x)"), (2, "surtr (x)")]


# Lookups.


def test_upgrades_by_either_edge_and_unknown_sizes(spark):
    local = spark.createDataFrame([(i, 1000, 2000) for i in range(8)], "md5 int, width int, height int")
    posts = spark.createDataFrame([(0, 1000, 2500), (1, 1000, 2000), (2, 0, 0), (3, None, 9), (4, 999, 1999), (5, 1001, 1500), (6, 2000, 1000), (7, 9000, 2900)], "md5 int, width int, height int")
    assert sorted(r.md5 for r in lookup.upgrade_candidates(local, posts).collect()) == [0, 2, 3, 5, 7]


def test_cache_hits_check_what_is_stored(spark):
    h = "00" * 16
    req = spark.createDataFrame([(1, h, "long", "m", "p")], "request_id int, image_hash string, caption_kind string, model string, prompt string")
    key = req.select(lookup.cache_key(F.col("image_hash"), F.col("caption_kind"), F.col("model"), F.col("prompt")).alias("k")).first().k
    schema = "cache_key string, image_hash string, caption_kind string, model string, prompt string, caption string, seq long"
    got = lambda *rows: [(r.tier, r.caption) for r in lookup.resolve_cached(req, spark.createDataFrame(list(rows), schema)).collect()]
    assert got((key, h, "long", "m", "p", "c", 1)) == [(0, "c")]
    for odd in ((key, h, "long", "m", "other", "c", 1), (key, "11" * 16, "long", "m", "p", "c", 1), (key, h, "short", "m", "p", "c", 1), (key, h, "long", "n", "p", "c", 1), (key, h, "long", "m", "p", "\t", 1)):
        assert got(odd) == [(None, None)]
    assert got((key, h, "long", "m", "other", "c", 1), ("k", h, "long", "m", "p\r\n".strip(), "d", 2)) == [(2, "d")]


def test_reports_have_sections_and_need_a_text(spark):
    schema = "name string, s string, l string, short string, vibes string, chars array<string>, _file string, _row long"
    rows = [("A", None, None, None, "v", ["c"], "f", 1), ("b", " x ", "x", "y", None, [], "f", 2), ("c", None, "l", "l", " v", ["p", "q"], "f", 3), ("d", None, "\n", "z", None, None, "f", 4), ("d", "late", None, None, None, None, "g", 1)]
    got = {r.name: r.report for r in lookup.reconstruct_reports(spark.createDataFrame(rows, schema), ["s"], ["l"], "short", ("S", "L", "C"), [("vibes", "Mood")], [("chars", "Tags")]).collect()}
    assert got == {"b": "# S\n\nx\n\n# C\n\ny", "c": "# S\n\nl\n\n# Mood\n\nv\n\n# Tags\n\np, q", "d": "# S\n\nz"}


# Texts.


def test_report_frames_and_quotes(spark):
    for text, want in (("## # x", "# x"), ("  ## # x", "# x"), ("## ## x", "## ## x"), ("format: a\n>\n# <format>\nb\n</format>", "format: a\nb"), ('"a"\n"b"', 'a"\n"b'), ('"', ""), ('""a""', '"a"'), ("{a}\r\nb", "a\nb"), (" \n", "")):
        assert one(spark, T.clean_report(F.lit(text))) == want, text


def test_references_end_at_whole_words(spark):
    for text, want in (("a h4 Costumes", "a"), ("at oh4.com daily", "at oh4.com daily"), ("b\nH5. Notes", "b"), ("c VOICED BY d", "c"), ("h44 e", "h44 e"), ("f h4_g", "f h4_g")):
        assert one(spark, T.clean_reference(F.lit(text))) == want, text


def test_queries_with_long_ratings(spark):
    q = spark.createDataFrame([(1, "tag rating:questionable score:=5"), (2, "tag rating:averyveryveryverylongname"), (3, None), (4, "tag rating:")], "id int, query string")
    got = {r.id: (r.tag, r.rating, r.score_op, r.score_value, r.valid) for r in gate.parse_query(q).collect()}
    assert got == {1: ("tag", "questionable", "=", 5, True), 2: ("tag", "averyveryveryverylongname", None, None, False), 3: (None, None, None, None, False), 4: ("tag", "", None, None, False)}
