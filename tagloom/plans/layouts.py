"""Queries of layout documents and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import norm
from tagloom.operators import captions, gate, layout, rules
from tagloom.plans.captions import ISSUES
from tagloom.plans.fixtures import table
from tagloom.plans.registry import query
from tagloom.sources import snapshots
from tagloom.sources.shared import many, scratch, spread
from tagloom.streaming import first_seen, stream

c = F.col


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft layout per part, of 60 by 60 pixels: a character's box and a text's; each of some rules is broken by some parts."""
    i = c("p_partkey")
    cut = lambda k, bad, good: F.when(i % k == 0, bad).otherwise(good)
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    first = join('{"label":"', cut(11, "ghost", "character"), '"', cut(41, "", ',"caption":"c"'), ',"bbox":[', i % 20, ",", i % 10, ",", cut(47, F.lit(0), i % 20 + 30), ",", i % 10 + 40, '.5],"tags":', cut(61, '"t"', F.concat(F.lit('["'), F.lower("p_brand"), F.lit('"]'))), "}")
    second = join('{"label":"text","caption":"d","bbox":', cut(7, "[1,2,3]", "[5,5,25,30]"), F.when(i % 43 == 0, "").when(i % 5 == 0, ',"text":" "').otherwise(F.concat(F.lit(',"text":"say '), i.cast("string"), F.lit('"'))), "}")
    summary = join("{", cut(31, "", '"caption":"s",'), '"meta":', cut(37, "[1]", "[]"), ',"canvas":"', cut(13, "round", "single"), '"}')
    doc = join('{"width":', cut(59, "61", "60"), ',"height":60,"summary":', summary, ',"items":', F.when(i % 67 == 0, "[]").otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))), ',"bbox_coord_space":"', cut(53, "abs_centralized", "abs"), '","bbox_format":"xyxy"', cut(29, ',"more":1', ""), "}")
    text = F.when(i % 17 == 0, F.lit('{"summary": 1, "summary": 2}')).when(i % 19 == 0, F.lit('{"items": NaN}')).when(i % 23 == 0, F.lit("{")).otherwise(doc)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(i.alias("record_id"), text.alias("layout"), F.lit(60).alias("width"), F.lit(60).alias("height"))


BAD = "(p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 23 = 0)"


@query(f"SELECT p_partkey AS record_id, NOT {BAD} AS parsed FROM part")
def g1_parse_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = layout.parse_layouts(documents(spark, sf_dir))
    return good.select("record_id", F.lit(True).alias("parsed")).unionAll(bad.select("record_id", F.lit(False)))


_rules = ((29, None, "fields"), (53, None, "coordinates"), (59, None, "dimensions"), (31, None, "summary fields"), (37, None, "meta"), (13, None, "canvas"), (67, None, "items"), (11, 0, "label"), (41, 0, "item fields"), (47, 0, "bbox"), (61, 0, "item tags"), (7, 1, "bbox"))
_each = " UNION ALL ".join(f"SELECT p_partkey AS record_id, {'NULL::INT' if item is None else item} AS item, '{rule}' AS rule FROM part WHERE NOT {BAD} AND p_partkey % {k} = 0" + (" AND p_partkey % 67 <> 0" if item is not None else "") for k, item, rule in _rules)


@query(f"{_each} UNION ALL SELECT p_partkey, 1, 'text' FROM part WHERE NOT {BAD} AND (p_partkey % 5 = 0 OR p_partkey % 43 = 0) AND p_partkey % 67 <> 0")
def g2_layout_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_violations(layout.parse_layouts(documents(spark, sf_dir))[0], draft=True)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-pixel edges, both orders and spaces, previews of another size, some reversed or outside."""
    i = c("p_partkey")
    w, h = c("p_size") * 10 + 101, c("p_size") * 7 + 53
    x1, y1, x2, y2 = (i % 40) * 0.25, (i % 30) * 0.5, F.when(i % 29 == 0, F.lit(0.0)).otherwise((i % 40) * 0.25 + 20), F.when(i % 31 == 0, F.lit(5000.0)).otherwise((i % 30) * 0.5 + 10.125)
    mid = i % 3 == 1
    sx, sy = F.when(mid, w / 2.0).otherwise(0.0), F.when(mid, h / 2.0).otherwise(0.0)
    a, b, d, e = x1 - sx, y1 - sy, x2 - sx, y2 - sy
    dec = lambda x: x.cast("decimal(20,6)")
    swapped = i % 2 == 0
    box = F.when(swapped, F.array(*map(dec, (b, a, e, d)))).otherwise(F.array(*map(dec, (a, b, d, e))))
    preview = lambda x: F.when(i % 3 == 2, x)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        i.alias("record_id"), box.alias("box"), w.alias("width"), h.alias("height"), F.when(mid, "abs_centralized").otherwise("abs").alias("space"), F.when(swapped, "yxyx").otherwise("xyxy").alias("format"), preview(F.lit(97)).alias("preview_w"), preview(F.lit(61)).alias("preview_h")
    )


# All edges are eighths, so integers of eighths are exact.
BOXES = """e AS (SELECT p_partkey AS record_id, p_size * 10 + 101 AS width, p_size * 7 + 53 AS height, (p_partkey % 40) * 2 AS x1, (p_partkey % 30) * 4 AS y1, CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE (p_partkey % 40) * 2 + 160 END AS x2, CASE WHEN p_partkey % 31 = 0 THEN 40000 ELSE (p_partkey % 30) * 4 + 81 END AS y2,
  CASE WHEN p_partkey % 3 = 2 THEN 97 ELSE p_size * 10 + 101 END AS pw, CASE WHEN p_partkey % 3 = 2 THEN 61 ELSE p_size * 7 + 53 END AS ph FROM part),
 px AS (SELECT record_id, width, height, 0 <= x1 AND x1 < x2 AND x2 <= 8 * pw AND 0 <= y1 AND y1 < y2 AND y2 <= 8 * ph AS valid, (x1 * width) // (8 * pw) AS a, (y1 * height) // (8 * ph) AS b, (x2 * width + 8 * pw - 1) // (8 * pw) AS c, (y2 * height + 8 * ph - 1) // (8 * ph) AS d FROM e)"""


@query(f"WITH {BOXES} SELECT record_id, valid, CASE WHEN valid THEN a::BIGINT END AS x1, CASE WHEN valid THEN b::BIGINT END AS y1, CASE WHEN valid THEN c::BIGINT END AS x2, CASE WHEN valid THEN d::BIGINT END AS y2 FROM px")
def g3_box_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.box_to_pixels(boxes(spark, sf_dir)).select("record_id", "valid", "x1", "y1", "x2", "y2")


@query(f"WITH {BOXES} SELECT record_id, b - height / 2.0::DOUBLE AS cy1, a - width / 2.0::DOUBLE AS cx1, d - height / 2.0::DOUBLE AS cy2, c - width / 2.0::DOUBLE AS cx2 FROM px WHERE valid")
def g4_center_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.center_boxes(layout.box_to_pixels(boxes(spark, sf_dir)).where("valid")).select("record_id", "cy1", "cx1", "cy2", "cx2")


@query(f"SELECT CASE WHEN p_partkey % 11 = 0 THEN 'ghost' ELSE 'character' END AS label, count(*) AS n FROM part WHERE NOT {BAD} AND p_partkey % 67 <> 0 GROUP BY 1 UNION ALL SELECT 'text', count(*) FROM part WHERE NOT {BAD} AND p_partkey % 67 <> 0")
def g5_layout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.label_counts(layout.layout_items(layout.parse_layouts(documents(spark, sf_dir))[0]))


@query(
    f"WITH b AS (SELECT p_partkey AS r, 0 AS item, p_partkey % 20 AS x1, p_partkey % 10 AS y1, CASE WHEN p_partkey % 47 = 0 THEN 0 ELSE p_partkey % 20 + 30 END AS x2, p_partkey % 10 + 40.5 AS y2 FROM part WHERE NOT {BAD} AND p_partkey % 67 <> 0 UNION ALL SELECT p_partkey, 1, 5, 5, 25, 30 FROM part WHERE NOT {BAD} AND p_partkey % 67 <> 0 AND p_partkey % 7 <> 0), "
    "p AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, l_partkey AS r, l_orderkey % 61 AS x, l_suppkey % 53 AS y FROM lineitem) SELECT point_id, max(item) AS item FROM p JOIN b USING (r) WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY 1"
)
def g6_boxes_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in its part's layout for each line of an order."""
    items = layout.layout_items(layout.parse_layouts(documents(spark, sf_dir))[0]).where(F.size("box") == 4)
    items = items.select("record_id", "item", *[F.get("box", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    points = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("point_id"), c("l_partkey").alias("record_id"), (c("l_orderkey") % 61).alias("x"), (c("l_suppkey") % 53).alias("y"))
    return layout.boxes_at(items, points)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """Documents as they would arrive, in a folder; their tags are language, source and, for some, blocked."""
    path = scratch(spark)
    tags = F.concat_ws(", ", c("lang"), c("source"), F.lit("Red_hat"), F.when(c("doc_id") % 11 == 0, "animated"))
    table(spark, sf_dir, "documents").select(c("doc_id").alias("record_id"), "text", c("source").alias("tag"), tags.alias("tags")).write.parquet(path)
    return path


def _stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("record_id long, text string, tag string, tags string").parquet(path)


def curate(records: DataFrame) -> DataFrame:
    """The chain of a record: gate, clean tags, caption issues, route; (record_id, tags, issues, status)."""
    spark = records.sparkSession
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    kept = gate.exclude_blocked_rows(records.withColumn("_tags", norm.parse_tags(c("tags"))), "_tags")[0].drop("_tags")
    tags = rules.clean_tags(kept.select("record_id", "tags"), "tags", rows([("en", "english")], "old string, new string"), rows([("de",)], "tag string"), rows([("rc1",)], "fragment string"), rows([("red hat", "fr")], "remove string, present string"))
    issues = captions.caption_issues(kept.select("record_id", "text"), most=40).select("record_id", "issues")
    none = rows([], "record_id long")
    return tags.join(issues, "record_id").join(captions.route_records(issues, none, none), "record_id")


@query(
    f"WITH src AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0), {ISSUES.replace('> 250', '> 40')} "
    "SELECT d.doc_id AS record_id, list_filter([CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN NULL ELSE lang END, CASE WHEN NOT contains(source, 'rc1') THEN source END, CASE WHEN lang = 'fr' THEN NULL ELSE 'red hat' END], lambda x: x IS NOT NULL) AS tags, issues, CASE WHEN len(issues) > 0 THEN 'review' ELSE 'done' END AS status FROM documents d JOIN chk ON chk.doc_id = d.doc_id"
)
def h1_curate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, tags, issues and routing in micro-batches, read again."""
    path = _folder(spark, sf_dir)
    stream.curate_stream(_stream(spark, path), curate, f"{path}-out", f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}-out").select("record_id", "tags", "issues", "status")


@query("SELECT md5(doc_id // 2 || lang) AS tag FROM documents GROUP BY 1 EXCEPT SELECT md5(doc_id // 2 || lang) FROM documents WHERE doc_id % 20 < 3")
def h2_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two documents may share, in batches of files, against those of a table."""
    path, key = scratch(spark), F.md5(F.concat(F.expr("cast(doc_id div 2 as string)"), "lang")).alias("tag")
    d, n = table(spark, sf_dir, "documents"), -(-many(spark) // 4)
    d.select(c("doc_id").alias("record_id"), "text", key, c("source").alias("tags")).repartitionByRange(4 * n, "record_id").write.parquet(path)
    files = spark.readStream.schema("record_id long, text string, tag string, tags string").option("maxFilesPerTrigger", n).parquet(path)
    first_seen.first_seen_stream(files, d.where("doc_id % 20 < 3").select(key), "tag", f"{path}-out", f"{path}-state", f"{path}-checkpoint", every=2).awaitTermination()
    return spark.read.parquet(f"{path}-out").select("tag")


@query("SELECT source AS tag, count(*) AS n FROM documents GROUP BY 1")
def h3_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, sf_dir)
    stream.replace(stream.running_counts(_stream(spark, path)), f"{path}-out", f"{path}-checkpoint").awaitTermination()
    return snapshots.read(spark, f"{path}-out")
