"""Layout rules, one broken at a time, and box arithmetic against rationals."""

import copy
import json
import math
import random
from fractions import Fraction

import pytest

from tagloom.operators import layout

GOOD = {
    "width": 60,
    "height": 40,
    "summary": {"caption": "s", "meta": ["a"], "canvas": "collage", "palette": []},
    "items": [{"label": "object", "caption": "c", "bbox": [0, 0, 30.25, 40]}, {"label": "text", "caption": "c", "text": "t", "bbox": [1, 2, 3, 4], "tags": ["x"], "palette": ["red"]}],
    "bbox_coord_space": "abs",
    "bbox_format": "xyxy",
}


def change(path, value):
    doc = copy.deepcopy(GOOD)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


BROKEN = [
    (change(["more"], 1), None, "fields"),
    (change(["bbox_format"], None), None, "fields"),
    (change(["summary"], None), None, "fields"),
    (change(["items"], None), None, "fields"),
    (change(["bbox_format"], "yxyx"), None, "coordinates"),
    (change(["bbox_coord_space"], 1), None, "coordinates"),
    (change(["width"], 61), None, "dimensions"),
    (change(["height"], 40.5), None, "dimensions"),
    (change(["height"], "40"), None, "dimensions"),
    (change(["summary"], "s"), None, "summary fields"),
    (change(["summary", "caption"], None), None, "summary fields"),
    (change(["summary", "more"], "x"), None, "summary fields"),
    (change(["summary", "caption"], " 　"), None, "summary caption"),
    (change(["summary", "caption"], 5), None, "summary caption"),
    (change(["summary", "canvas"], "square"), None, "canvas"),
    (change(["summary", "canvas"], []), None, "canvas"),
    (change(["summary", "meta"], "a"), None, "meta"),
    (change(["summary", "meta"], ["a", 1]), None, "meta"),
    (change(["summary", "palette"], ["a", " "]), None, "palette"),
    (change(["items"], []), None, "items"),
    (change(["items"], {"a": 1}), None, "items"),
    (change(["items", 0], 7), 0, "item fields"),
    (change(["items", 0, "bbox"], None), 0, "item fields"),
    (change(["items", 1, "parent"], 0), 1, "item fields"),
    (change(["items", 0, "label"], "person"), 0, "label"),
    (change(["items", 0, "label"], 3), 0, "label"),
    (change(["items", 1, "caption"], ""), 1, "item caption"),
    (change(["items", 1, "text"], None), 1, "text"),
    (change(["items", 0, "text"], "\t"), 0, "text"),
    (change(["items", 1, "text"], ["t"]), 1, "text"),
    (change(["items", 1, "tags"], [None]), 1, "item tags"),
    (change(["items", 1, "palette"], "red"), 1, "item palette"),
    (change(["items", 0, "bbox"], [0, 0, 30]), 0, "bbox"),
    (change(["items", 0, "bbox"], [0, 0, 0, 5]), 0, "bbox"),
    (change(["items", 0, "bbox"], [5, 0, 3, 5]), 0, "bbox"),
    (change(["items", 0, "bbox"], [0, 0, 60.0000001, 5]), 0, "bbox"),
    (change(["items", 0, "bbox"], [0, 0, True, 5]), 0, "bbox"),
    (change(["items", 0, "bbox"], ["0", 0, 3, 5]), 0, "bbox"),
    (change(["items", 0, "bbox"], 4), 0, "bbox"),
    (change(["items", 0, "caption"], "a\ud800b"), None, "unicode"),
    ("[]", None, "fields"),
    ("{", None, "json"),
    (None, None, "json"),
]


def test_each_broken_rule_gives_just_that(spark):
    rows = [(i, t, 60, 40) for i, (t, _, _) in enumerate(BROKEN)] + [(900, json.dumps(GOOD), 60, 40), (901, change(["summary"], {"caption": "only \U0001f600"}), 60, 40)]
    df = spark.createDataFrame(rows, "record_id int, layout string, width int, height int")
    got = {}
    for r in layout.layout_violations(df, draft=True).collect():
        got.setdefault(r.record_id, []).append((r.item, r.rule))
    assert got == {i: [(item, rule)] for i, (_, item, rule) in enumerate(BROKEN)}


def test_finished_layouts_are_centred(spark):
    doc = {k: v for k, v in GOOD.items() if k not in ("width", "height")} | {"bbox_coord_space": "abs_centralized", "bbox_format": "yxyx"}
    doc["items"] = [{"label": "object", "caption": "c", "bbox": [-20.5, -30, 20.5, 30]}, {"label": "object", "caption": "c", "bbox": [-20.6, -30, 20, 30]}]
    df = spark.createDataFrame([(1, json.dumps(doc), 60, 41), (2, json.dumps(GOOD), 60, 40), (3, json.dumps(doc), 0, 41)], "record_id int, layout string, width int, height int")
    got = sorted((r.record_id, r.item if r.item is not None else -1, r.rule) for r in layout.layout_violations(df).collect())
    assert got == [(1, 1, "bbox"), (2, -1, "coordinates"), (2, -1, "fields"), (2, 0, "bbox"), (3, -1, "canvas size"), (3, 0, "bbox"), (3, 1, "bbox")]
    assert layout.layout_violations(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["0", "-0", "0.0000001", "1e-7", "12.50", "-3.25", "7E2", "-1.5e1", "0e999", "1e-28", "9999999999", "0.1234567890123456789012345678", "+4"])
def test_numbers_are_exact(spark, text):
    r = spark.range(1).select(layout.exact_number(F_lit(text)).alias("n")).first().n
    assert Fraction(r.i) + Fraction(int(r.g), 10**28) == Fraction(text) and 0 <= r.g < 10**28


@pytest.mark.parametrize("text", ["", "x", "NaN", "1e400", "1e-29", "10000000000", "0.12345678901234567890123456789", "1.", "0x1", None])
def test_other_numbers_have_no_value(spark, text):
    from pyspark.sql import functions as F

    r = spark.range(1).select(layout.exact_number(F.lit(text).cast("string")).alias("n")).first().n
    assert r is None or text == "1." and r.i == 1


def F_lit(text):
    from pyspark.sql import functions as F

    return F.lit(text)


def plain_box(box, width, height, space, form, pw, ph):
    """The rule in rationals: None for boxes that aren't valid."""
    if len(box) != 4 or any(b is None for b in box) or width <= 0 or height <= 0:
        return None
    a, b, c, d = map(Fraction, box)
    x1, y1, x2, y2 = (a, b, c, d) if form == "xyxy" else (b, a, d, c)
    if space == "abs_centralized":
        pw, ph = width, height
        x1, x2, y1, y2 = x1 + Fraction(width, 2), x2 + Fraction(width, 2), y1 + Fraction(height, 2), y2 + Fraction(height, 2)
    pw, ph = pw or width, ph or height
    if not (0 <= x1 < x2 <= pw and 0 <= y1 < y2 <= ph):
        return None
    return math.floor(x1 * width / pw), math.floor(y1 * height / ph), math.ceil(x2 * width / pw), math.ceil(y2 * height / ph)


def test_boxes_agree_with_rationals(spark):
    rng = random.Random(4)
    rows = [
        (["0.0000001", "0", "1", "1"], 3, 3, "abs", "xyxy", None, None),
        (["0.3333333333333333333333333333", "0", "0.6666666666666666666666666667", "1"], 3, 9, "abs", "xyxy", 1, 1),
        (["0.3333333333333333333333333334", "0", "0.6666666666666666666666666666", "1"], 3, 9, "abs", "xyxy", 1, 1),
        (["0", "0", "2147483647", "2147483647"], 2147483647, 2147483647, "abs", "xyxy", None, None),
        (["0.0000000000000000000000000001", "0", "2147483646.9999999999999999999999999999", "1"], 2147483647, 5, "abs", "xyxy", 2147483647, 2),
        (["-1.5", "-1.5", "1.5", "1.5"], 3, 3, "abs_centralized", "yxyx", None, None),
        (["-1.5000000001", "-1.5", "1.5", "1.5"], 3, 3, "abs_centralized", "yxyx", None, None),
        (["0", "0", "1", None], 3, 3, "abs", "xyxy", None, None),
        (["0", "0", "1"], 3, 3, "abs", "xyxy", None, None),
        (["0", "0", "1", "1"], 0, 3, "abs", "xyxy", None, None),
    ]
    for _ in range(300):
        w, h = rng.randint(1, 5000), rng.randint(1, 5000)
        pw, ph = rng.choice([(None, None), (rng.randint(1, 900), rng.randint(1, 900))])
        space = rng.choice(["abs", "abs_centralized"])
        mw, mh = ((w, h) if space == "abs_centralized" or pw is None else (pw, ph))
        off = (Fraction(mw, 2), Fraction(mh, 2)) if space == "abs_centralized" else (0, 0)
        places = rng.choice([0, 1, 3, 12, 27])
        pick = lambda m, o: f"{float(rng.randint(0, m)) - float(o):.1f}" if places < 2 else str(rng.randint(-1, m)) + "." + "".join(rng.choice("0359") for _ in range(places))
        xs, ys = sorted([pick(mw, off[0]), pick(mw, off[0])], key=Fraction), sorted([pick(mh, off[1]), pick(mh, off[1])], key=Fraction)
        form = rng.choice(["xyxy", "yxyx"])
        box = [xs[0], ys[0], xs[1], ys[1]] if form == "xyxy" else [ys[0], xs[0], ys[1], xs[1]]
        rows.append((box, w, h, space, form, pw, ph))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, box array<string>, width int, height int, space string, format string, preview_w int, preview_h int")
    got = {r.id: (r.x1, r.y1, r.x2, r.y2) if r.valid else None for r in layout.box_to_pixels(df).collect()}
    want = {i: plain_box(*r) for i, r in enumerate(rows)}
    assert got == want
    assert sum(v is not None for v in want.values()) > 100


def test_hit_test_includes_edges(spark):
    items = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 10, 10, 20, 20)], "record_id int, item int, x1 int, y1 int, x2 int, y2 int")
    points = spark.createDataFrame([(1, 1, 10, 10), (2, 1, 20, 15), (3, 1, 0, 0), (4, 1, 21, 15), (5, 2, 1, 1)], "point_id int, record_id int, x int, y int")
    assert {r.point_id: r.item for r in layout.boxes_at(items, points).collect()} == {1: 1, 2: 1, 3: 0}
