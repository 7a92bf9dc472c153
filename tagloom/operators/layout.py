"""Layout documents: parsing, rules, boxes in exact numbers.

A coordinate is a whole number of pixels and a fraction in units of 10**-28, both exact: the texts of numbers are read digit by
digit, and scaling divides integers. Fractions of more than 28 places, and edges of more than ten digits, make a box invalid.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

ITEM = "struct<label:string,caption:string,bbox:array<decimal(38,12)>,text:string,tags:array<string>>"
SCHEMA = f"struct<summary:struct<caption:string,meta:array<string>,canvas:string,palette:array<string>>,items:array<{ITEM}>,bbox_coord_space:string,bbox_format:string>"
# Fixed values of the format: labels, kinds of canvas, fields, and the coordinates of drafts and of finished layouts.
LABELS = ("object", "character", "text")
CANVASES = ("single", "multi_panel", "collage")
ROOT_FIELDS = ("summary", "items", "bbox_coord_space", "bbox_format")
DRAFT_FIELDS = ("width", "height")
SUMMARY_FIELDS = ("caption", "meta", "canvas", "palette")
ITEM_FIELDS = ("label", "caption", "bbox", "text", "tags", "palette")
COORDINATES = {True: ("abs", "xyxy"), False: ("abs_centralized", "yxyx")}
NUMBER = r"^([+-]?)([0-9]+)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,3}))?$"
#: Decimal places of a fraction, and digits of an edge.
PLACES = 28
DIGITS = 10


@F.pandas_udf(BooleanType())
def strict_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text is JSON without repeated keys and numbers that aren't finite; no built-in function tells."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no(name: str) -> None:
        raise ValueError(name)

    def check(t: str | None) -> bool:
        try:
            json.loads(t, object_pairs_hook=once, parse_constant=no)
        except (TypeError, ValueError):
            return False
        return True

    for s in parts:
        yield s.map(check).astype("bool")


def parse_layouts(df: DataFrame, col: str = "layout") -> tuple[DataFrame, DataFrame]:
    """G1: df with the parsed `doc`, and rejects (record_id, reason)."""
    # A generated column is parsed once, where the rows are, and not in a filter before they are dealt out.
    x = df.withColumn("_ok", strict_json(F.col(col))).select("*", F.inline(F.array(F.struct(F.from_json(F.col(col), SCHEMA).alias("doc")))))
    bad = ~F.col("_ok") | F.col("doc").isNull()
    return x.where(~bad).drop("_ok"), x.where(bad).select("record_id", F.lit("layout is no strict JSON object").alias("reason"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_number(text: Column) -> Column:
    """struct(i, g) of the text of a number, which is i + g / 10**28 with 0 <= g < 10**28; null if it doesn't fit."""
    most = DIGITS + PLACES
    unit = F.lit(str(10**PLACES)).cast(f"decimal({PLACES + 1},0)")
    # Zeros on either side, so that the point stands inside; numbers that need more of them have no value here.
    zeros = lambda n: F.repeat(F.lit("0"), F.least(F.greatest(n, F.lit(0)), F.lit(most)))

    def parts(t: Column) -> Column:
        power = F.coalesce(F.nullif(F.regexp_extract(t, NUMBER, 4), F.lit("")).cast("int"), F.lit(0))
        return F.struct(F.regexp_extract(t, NUMBER, 1).alias("sign"), F.regexp_extract(t, NUMBER, 2).alias("whole"), F.regexp_extract(t, NUMBER, 3).alias("part"), power.alias("power"))

    def pointed(p: Column) -> Column:
        digits, point = F.concat(p["whole"], p["part"]), F.length(p["whole"]) + p["power"]
        return F.struct(p["sign"].alias("sign"), p["power"].alias("power"), (F.ltrim(digits, F.lit("0")) == "").alias("null"), F.concat(zeros(-point), digits, zeros(point - F.length(digits))).alias("padded"), F.greatest(point, F.lit(0)).alias("at"))

    def sides(p: Column) -> Column:
        left, right = F.ltrim(F.left(p["padded"], p["at"]), F.lit("0")), F.rtrim(F.substring(p["padded"], p["at"] + 1, F.length(p["padded"])), F.lit("0"))
        return F.struct(p["sign"].alias("sign"), p["power"].alias("power"), p["null"].alias("null"), left.alias("left"), right.alias("right"))

    def values(p: Column) -> Column:
        fits = p["null"] | ((F.length(p["left"]) <= DIGITS) & (F.length(p["right"]) <= PLACES) & (F.abs(p["power"]) <= most))
        i = F.when(p["null"], F.lit(0)).otherwise(F.coalesce(F.nullif(p["left"], F.lit("")).try_cast("long"), F.lit(0))).cast("long")
        g = F.when(p["null"], F.lit("0")).otherwise(F.rpad(p["right"], PLACES, "0")).try_cast(f"decimal({PLACES},0)")
        return F.when(fits, F.struct((p["sign"] == "-").alias("below"), i.alias("i"), g.alias("g")))

    def number(n: Column) -> Column:
        signed = F.struct(
            F.when(n["below"], -n["i"] - F.when(n["g"] > 0, 1).otherwise(0)).otherwise(n["i"]).alias("i"),
            F.when(n["below"] & (n["g"] > 0), (unit - n["g"]).cast(f"decimal({PLACES},0)")).otherwise(n["g"]).alias("g"),
        )
        return F.when(n.isNotNull(), signed)

    found = _once(_once(_once(_once(parts(text), pointed), sides), values), number)
    return F.when(text.rlike(NUMBER), found)


def _moved(number: Column, size: Column) -> Column:
    """The number plus half of a size."""
    half = F.lit(str(5 * 10 ** (PLACES - 1))).cast(f"decimal({PLACES + 1},0)")
    unit = F.lit(str(10**PLACES)).cast(f"decimal({PLACES + 1},0)")

    def carried(n: Column) -> Column:
        carry = n["g"] >= unit
        return F.struct((n["i"] + F.when(carry, 1).otherwise(0)).alias("i"), F.when(carry, n["g"] - unit).otherwise(n["g"]).cast(f"decimal({PLACES},0)").alias("g"))

    g = number["g"] + F.when(F.pmod(size, F.lit(2)) == 1, half).otherwise(F.lit(0).cast(f"decimal({PLACES + 1},0)"))
    return _once(F.struct((number["i"] + F.floor(size / 2).cast("long")).alias("i"), g.alias("g")), carried)


def _edges(box: Column, width: Column, height: Column, space: Column, form: Column, preview_w: Column, preview_h: Column) -> Column:
    """struct(x1, y1, x2, y2, pw, ph) of exact edges from the upper left corner, if the box is valid; else null."""
    at = lambda k: F.get(box, F.lit(k))
    swapped, centred = form == "yxyx", space == "abs_centralized"

    def put(k: int, other: int, size: Column) -> Column:
        return _once(F.when(swapped, at(other)).otherwise(at(k)), lambda n: F.when(centred, _moved(n, size)).otherwise(n))

    x1, y1, x2, y2 = put(0, 1, width), put(1, 0, height), put(2, 3, width), put(3, 2, height)
    pw, ph = (F.when(centred, size).otherwise(F.coalesce(p, size)).cast("long") for p, size in ((preview_w, width), (preview_h, height)))
    zero = F.lit(0).cast(f"decimal({PLACES},0)")
    end = lambda n: F.struct(n.alias("i"), zero.alias("g"))
    null = end(F.lit(0).cast("long"))
    known = form.isin("xyxy", "yxyx") & space.isin("abs", "abs_centralized") & (F.size(box) == 4) & F.forall(box, lambda n: n.isNotNull())

    def valid(e: Column) -> Column:
        sizes = (width > 0) & (height > 0) & (e["pw"] > 0) & (e["ph"] > 0) & (F.greatest(width, height, e["pw"], e["ph"]) < 1 << 31)
        inside = (e["x1"] >= null) & (e["x1"] < e["x2"]) & (e["x2"] <= end(e["pw"])) & (e["y1"] >= null) & (e["y1"] < e["y2"]) & (e["y2"] <= end(e["ph"]))
        return F.when(F.coalesce(known & sizes & inside, F.lit(False)), e)

    return _once(F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), pw.alias("pw"), ph.alias("ph")), valid)


def _scaled(edge: Column, size: Column, preview: Column, up: bool) -> Column:
    """edge * size / preview in whole pixels, down or up: quotient and rest of the whole part, then the fraction on the rest."""
    unit = F.lit(str(10**PLACES)).cast("decimal(29,0)")
    under = (preview.cast("decimal(10,0)") * unit).cast("decimal(38,0)")

    def parted(p: Column) -> Column:
        over = (p["rest"].cast("decimal(10,0)") * unit + edge["g"] * size.cast("decimal(10,0)")).cast("decimal(38,0)")
        # Quotients without a rest are exact as decimals.
        quotient = ((p["product"] - p["rest"]).cast("decimal(20,0)") / preview.cast("decimal(10,0)")).cast("long")
        return F.struct(quotient.alias("quotient"), over.alias("over"), F.pmod(over, under).alias("more"))

    def added(p: Column) -> Column:
        whole = ((p["over"] - p["more"]) / under).cast("long")
        return p["quotient"] + whole + (F.when(p["more"] > 0, 1).otherwise(0) if up else F.lit(0))

    product = edge["i"] * size.cast("long")
    return _once(_once(F.struct(product.alias("product"), F.pmod(product, preview).alias("rest")), parted), added)


def box_to_pixels(df: DataFrame) -> DataFrame:
    """Df (box array, width, height, space, format, preview_w, preview_h) with x1, y1, x2, y2 pixels and valid.

    box holds numbers or their texts. Edges are checked before rounding; low edges are rounded down and high ones up.
    Spaces: abs (scaled from the preview if there is one), abs_centralized (origin in the middle of the canvas). Null or missing
    numbers, ones too long for exact arithmetic, reversed, empty or outer boxes and sizes that aren't positive are not valid.
    """
    numbers = F.transform("box", lambda n: exact_number(n.cast("string")))
    df = df.select("*", numbers.alias("_n"))
    df = df.select("*", _edges(*[F.col(c) for c in ("_n", "width", "height", "space", "format", "preview_w", "preview_h")]).alias("_e")).drop("_n")
    e = F.col("_e")
    x1, x2 = (_scaled(e[n], F.col("width"), e["pw"], n == "x2").alias(n) for n in ("x1", "x2"))
    y1, y2 = (_scaled(e[n], F.col("height"), e["ph"], n == "y2").alias(n) for n in ("y1", "y2"))
    # As generated columns, so that a filter on them isn't pushed below and worked out apart.
    return df.select("*", F.inline(F.array(F.struct(e.isNotNull().alias("valid"), x1, y1, x2, y2)))).drop("_e")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, a number's type, BOOLEAN or VOID; null for a field that isn't there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _filled(v: Column) -> Column:
    """Whether a variant is a string with more than white space."""
    return (_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(r"[^\s\p{Z}\x1c-\x1f\x85]")


def _filled_strings(v: Column) -> Column:
    return (_kind(v) == "ARRAY") & F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(_filled(x), F.lit(False)))


def _keys(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _fields(v: Column, keys: Column, allowed: tuple[str, ...], required: tuple[str, ...]) -> Column:
    """Whether a variant is an object with all required fields and no others than the allowed ones."""
    of = lambda names: F.array(*map(F.lit, names))
    return F.coalesce((_kind(v) == "OBJECT") & (F.size(F.array_except(keys, of(allowed))) == 0) & (F.size(F.array_except(of(required), keys)) == 0), F.lit(False))


def layout_violations(df: DataFrame, col: str = "layout", draft: bool = False) -> DataFrame:
    """(record_id, item, rule) of all rules that the layouts of df (record_id, `col`, width, height) break.

    item is null for rules of the whole document. Rules of a value hold where its field is there; a missing or unknown field breaks
    the rule of the fields alone, and what stands inside an object of wrong fields is judged as far as it is there. Rules: canvas
    size, json, fields, coordinates, dimensions (drafts state the size of the canvas), unicode (half of a surrogate pair),
    summary fields, summary caption, canvas, meta, palette, items; of each item item fields, label, item caption, text, item
    tags, item palette, bbox. Drafts have their boxes from the upper left corner in x, y, others from the middle in y, x.
    A null layout breaks json; an empty table gives no rows; repeated rows give repeated ones.
    """
    space, form = COORDINATES[draft]
    root = ROOT_FIELDS + (DRAFT_FIELDS if draft else ())
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    v = F.col("_v")
    x = df.select("record_id", F.col("width").cast("long").alias("_w"), F.col("height").cast("long").alias("_h"), F.col(col).alias("_text"), F.try_parse_json(col).alias("_v"))
    x = x.select("*", _keys(v).alias("_keys"), field(v, "summary").alias("_summary"), field(v, "items").alias("_items"))
    x = x.select("*", _keys(F.col("_summary")).alias("_own"))
    s, own = F.col("_summary"), F.col("_own")
    there = lambda name: F.array_contains("_keys", name)
    broken = lambda test, rule: F.when(~F.coalesce(test, F.lit(False)), rule)
    has = lambda keys, name, test: ~F.array_contains(keys, name) | F.coalesce(test, F.lit(False))
    word = lambda name, want: has(F.col("_keys"), name, (_kind(field(v, name)) == "STRING") & (F.try_variant_get(v, f"$.{name}", "string") == want))
    size = lambda name, want: has(F.col("_keys"), name, (_kind(field(v, name)) == "BIGINT") & (F.try_variant_get(v, f"$.{name}", "long") == want))
    inner = F.coalesce(_kind(s) == "OBJECT", F.lit(False))
    whole = [
        broken((F.col("_w") > 0) & (F.col("_h") > 0), "canvas size"),
        broken(v.isNotNull(), "json"),
        F.when(v.isNotNull(), broken(_fields(v, F.col("_keys"), root, root), "fields")),
        broken(word("bbox_coord_space", space) & word("bbox_format", form), "coordinates"),
        broken(size("width", F.col("_w")) & size("height", F.col("_h")), "dimensions") if draft else F.lit(None).cast("string"),
        F.when(F.col("_text").rlike(r"(?i)\\u(?:d[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2}\\u)d[c-f][0-9a-f]{2})"), "unicode"),
        F.when(there("summary"), broken(_fields(s, own, SUMMARY_FIELDS, ("caption",)), "summary fields")),
        F.when(inner, broken(has(own, "caption", _filled(field(s, "caption"))), "summary caption")),
        F.when(inner, broken(has(own, "canvas", (_kind(field(s, "canvas")) == "STRING") & F.try_variant_get(s, "$.canvas", "string").isin(*CANVASES)), "canvas")),
        *[F.when(inner, broken(has(own, n, _filled_strings(field(s, n))), n)) for n in ("meta", "palette")],
        F.when(there("items"), broken((_kind(F.col("_items")) == "ARRAY") & (F.size(F.try_variant_get("_items", "$", "array<variant>")) > 0), "items")),
    ]
    a = x.select("record_id", F.lit(None).cast("int").alias("item"), F.explode(F.array_compact(F.array(*whole))).alias("rule"))
    i, k = F.col("_i"), F.col("_k")
    y = x.select("record_id", "_w", "_h", F.posexplode(F.try_variant_get("_items", "$", "array<variant>")).alias("item", "_i")).select("*", _keys(i).alias("_k"))
    y = y.select("*", F.try_variant_get(i, "$.bbox", "array<variant>").alias("_b"))
    number = F.forall("_b", lambda n: F.coalesce(_kind(n).isin("BIGINT", "DECIMAL", "DOUBLE"), F.lit(False)))
    y = y.select("*", F.when(number, F.transform("_b", lambda n: exact_number(F.try_variant_get(n, "$", "string")))).alias("_n"))
    none = F.lit(None).cast("long")
    valid = _edges(F.col("_n"), F.col("_w"), F.col("_h"), F.lit(space), F.lit(form), none, none).isNotNull()
    one = F.coalesce(_kind(i) == "OBJECT", F.lit(False))
    label = F.try_variant_get(i, "$.label", "string")
    each = [
        broken(_fields(i, k, ITEM_FIELDS, ("label", "caption", "bbox")), "item fields"),
        F.when(one, broken(has(k, "label", (_kind(field(i, "label")) == "STRING") & label.isin(*LABELS)), "label")),
        F.when(one, broken(has(k, "caption", _filled(field(i, "caption"))), "item caption")),
        F.when(one, broken(has(k, "text", _filled(field(i, "text"))) & (F.array_contains(k, "text") | F.coalesce(label != "text", F.lit(True))), "text")),
        *[F.when(one, broken(has(k, n, _filled_strings(field(i, n))), f"item {n}")) for n in ("tags", "palette")],
        F.when(one, broken(has(k, "bbox", valid), "bbox")),
    ]
    b = y.select("record_id", "item", F.explode(F.array_compact(F.array(*each))).alias("rule"))
    return a.unionAll(b)


def center_boxes(df: DataFrame) -> DataFrame:
    """Df (x1, y1, x2, y2, width, height) with cy1, cx1, cy2, cx2 around the middle of the canvas."""
    return df.select("*", *[(F.col(c) - F.col(size) / 2.0).alias(f"c{c[0]}{c[1]}") for c, size in (("y1", "height"), ("x1", "width"), ("y2", "height"), ("x2", "width"))])


def layout_items(df: DataFrame) -> DataFrame:
    """(record_id, item, label, caption, text, tags, box) of parsed layouts."""
    return df.select("record_id", F.posexplode("doc.items").alias("item", "i")).select("record_id", "item", "i.label", "i.caption", "i.text", "i.tags", F.col("i.bbox").alias("box"))


def boxes_at(items: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, item): the top-most box (highest item) of the point's record that holds it, edges included; items (x1, y1, x2, y2)."""
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return points.join(items, "record_id").where(inside).groupBy("point_id").agg(F.max("item").alias("item"))


def label_counts(items: DataFrame) -> DataFrame:
    """(label, n)"""
    return items.groupBy("label").agg(F.count("*").alias("n"))
