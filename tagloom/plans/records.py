"""Queries of admission, matching and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import gate
from tagloom.plans.fixtures import posts, record_tags, sql, table
from tagloom.plans.quotas import QUERIES, _queries
from tagloom.plans.registry import query

c = F.col


def _df(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_tags(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query("WITH b AS (SELECT record_id, list_sort(list(DISTINCT CASE tag WHEN 'anvil' THEN 'animated' ELSE tag END)) AS matched FROM record_tags WHERE tag IN ('hot', 'brand#9', 'anvil') GROUP BY 1) SELECT DISTINCT record_id, coalesce(matched, []) AS matched FROM record_tags LEFT JOIN b USING (record_id)")
def a1_exclude_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept records with no match, rejected ones with theirs; one word stands for an always-blocked tag."""
    rt = record_tags(spark, sf_dir).withColumn("tag", F.when(c("tag") == "anvil", "Animated").otherwise(c("tag")))
    return gate.gate_records(rt, _df(spark, [("HOT",), ("brand#9",)], "tag string")).select("record_id", "matched")


@query("SELECT DISTINCT md5(o_custkey::VARCHAR) AS md5 FROM orders WHERE o_custkey % 5 <> 0")
def a2_valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.when(c("o_custkey") % 5 == 0, "zz").otherwise(F.concat(F.lit(" "), F.upper(F.md5(c("o_custkey").cast("string"))), F.lit(" "))).alias("md5"))
    return gate.valid_ids(ids, "md5")


@query("SELECT md5 FROM posts WHERE id NOT IN (SELECT c_custkey FROM customer)")
def a3_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").select(F.md5(c("c_custkey").cast("string")).alias("md5"))
    return gate.missing_ids(posts(spark, sf_dir).select("md5"), have)


@query("WITH h AS (SELECT md5(o_custkey::VARCHAR) AS md5, o_orderstatus AS location, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority FROM orders) SELECT md5, arg_min(location, priority) AS location FROM h WHERE md5 IN (SELECT md5 FROM posts) GROUP BY 1")
def a3_locate_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(F.md5(c("o_custkey").cast("string")).alias("md5"), c("o_orderstatus").alias("location"), F.when(c("o_orderstatus") == "P", 0).when(c("o_orderstatus") == "O", 1).otherwise(2).alias("priority"))
    return gate.locate_existing(posts(spark, sf_dir).select("md5"), have)


@query("SELECT id, md5 FROM posts WHERE rating <> 'e' AND id IN (SELECT c_custkey FROM customer)")
def a4_select_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = posts(spark, sf_dir).select("id", "md5", F.when(c("rating") != "e", "x.txt").alias("partner"))
    return gate.select_pairs(recs, table(spark, sf_dir, "customer").select(F.md5(c("c_custkey").cast("string")).alias("md5")), "partner").select("id", "md5")


@query("SELECT record_id FROM record_tags GROUP BY 1 HAVING ((bool_or(tag = 'red') AND bool_or(tag = 'hot')) OR bool_or(contains(tag, 'izm'))) AND NOT bool_or(tag = 'promo')")
def a5_match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.match_records(_records(spark, sf_dir), ["red", "hot"], ["promo"], "AND", "izm").select("record_id")


@query(
    "WITH m AS (SELECT DISTINCT record_id FROM record_tags WHERE tag = 'ring'), f AS (SELECT DISTINCT record_id, record_id || '.' || folder AS name FROM record_tags JOIN m USING (record_id)), k AS (SELECT * FROM f WHERE NOT (name LIKE '%.A' AND record_id % 2 = 0)) "
    "SELECT (SELECT count(DISTINCT record_id) FROM f) AS matched, (SELECT count(*) FROM k) AS moved, (SELECT count(*) FROM f) - (SELECT count(*) FROM k) AS skipped"
)
def a6_select_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = record_tags(spark, sf_dir).select("record_id", F.concat_ws(".", "record_id", "folder").alias("name")).distinct()
    recs = gate.match_records(_records(spark, sf_dir), ["ring"], [])
    return gate.select_bundles(recs, files, files.where("name like '%.A' and record_id % 2 = 0"))[1]


@query("SELECT id FROM posts WHERE rating IN ('g', 'general') AND status = 'O'")
def a7_filter_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).withColumn("tags", F.array(F.lit("x"), F.when(c("status") == "O", "flagged").otherwise("plain")))
    return gate.filter_posts(p, "g", "flagged").select("id")


@query(
    f"WITH q AS ({_queries}) SELECT id, CASE id % 7 WHEN 2 THEN 'a' WHEN 3 THEN '-tag_a' WHEN 5 THEN 'official_art' ELSE 'tag_a' END AS tag, CASE id % 7 WHEN 0 THEN 'safe' WHEN 6 THEN 'e' END AS rating, CASE id % 7 WHEN 0 THEN '>=' WHEN 4 THEN '=' WHEN 6 THEN '<' END AS score_op, CASE id % 7 WHEN 0 THEN 5 WHEN 4 THEN 3 WHEN 6 THEN -2 END AS score_value, id % 7 = 1 AS flag, id % 7 IN (0, 1, 5, 6) AS valid FROM q"
)
def a8_parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.parse_query(sql(spark, sf_dir, QUERIES, "orders")).drop("source", "target", "status", "query")


@query("SELECT id FROM posts WHERE CASE id % 5 WHEN 0 THEN score >= 50 WHEN 1 THEN score <= 50 WHEN 2 THEN score > 100 WHEN 3 THEN score < 20 ELSE true END")
def a9_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    m = c("id") % 5
    op = F.when(m == 0, ">=").when(m == 1, "<=").when(m == 2, ">").when(m == 3, "<")
    return p.where(gate.score_matches(c("score"), op, F.when(m <= 1, 50).when(m == 2, 100).otherwise(20))).select("id")


@query(
    "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN status = 'P' AND id % 3 = 0 THEN 'blacklisted' WHEN id % 11 = 0 THEN 'unavailable' WHEN id IN (SELECT c_custkey FROM customer) THEN 'skipped' WHEN id % 13 = 0 THEN 'unavailable' WHEN id % 17 = 0 THEN 'unavailable' ELSE 'eligible' END AS outcome FROM posts) GROUP BY 1"
)
def a10_triage_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    p = p.select(
        "id",
        F.when(c("id") % 11 == 0, "bad").otherwise(F.upper("md5")).alias("md5"),
        F.array(F.lit("solo"), F.when((c("status") == "P") & (c("id") % 3 == 0), "Bad_Tag").otherwise("ok")).alias("tags"),
        F.when(c("id") % 13 == 0, "http://x/a.png").otherwise("HTTPS://x/a.png").alias("file_url"),
        F.when(c("id") % 17 == 0, "mp4").otherwise("PNG").alias("file_ext"),
    )
    have = table(spark, sf_dir, "customer").select(F.md5(c("c_custkey").cast("string")).alias("md5"))
    return gate.triage_posts(p, have, _df(spark, [("bad tag",)], "tag string")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT record_id, list(DISTINCT tag) AS tags, list(DISTINCT tag) FILTER (tag LIKE 'brand%') AS b FROM record_tags GROUP BY 1) SELECT record_id, md5(record_id::VARCHAR) AS md5, b[1] AS character FROM r WHERE len(b) = 1 AND list_contains(tags, 'ring') AND NOT list_bool_or(list_transform(tags, lambda t: contains(t, 'ld'))) AND b[1] <> 'brand#3' AND record_id % 2 = 1"
)
def a11_reference_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _records(spark, sf_dir)
    meta = recs.select("record_id", F.md5(c("record_id").cast("string")).alias("md5"), F.filter("tags", lambda t: F.startswith(t, F.lit("brand"))).alias("characters"), F.transform("tags", lambda t: F.when(t == "ring", "solo").otherwise(t)).alias("tags"))
    tried = meta.where("record_id % 2 = 0").select(F.explode("characters").alias("character"), "md5", F.lit("m").alias("model"))
    return gate.reference_candidates(meta, _df(spark, [("brand#3",)], "character string"), tried, _df(spark, [("ld",)], "word string"), "m")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 4 AND o_totalprice >= 200000 AND o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderkey % 3 <> 0")
def a12_discovery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tags = o.select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 3 == 0, "a b").otherwise("ab").alias("name"), (c("o_orderkey") % 5).alias("category"), c("o_totalprice").alias("post_count"), c("o_orderdate").alias("created_at"), F.when(c("o_orderstatus") == "P", True).when(c("o_orderstatus") == "O", False).alias("is_deprecated"))
    return gate.discovery_filter(tags, 4, 200000, "1997-01-01").select("id")


@query("SELECT id AS record_id, CASE WHEN id % 4 = 0 THEN 'complete' WHEN id % 3 = 0 THEN 'cached' WHEN status = 'P' THEN 'missing_metadata' ELSE 'pending' END AS status FROM posts")
def a13_pending_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).select(c("id").alias("record_id"), "status")
    return gate.pending_records(p, p.where("record_id % 4 = 0"), p.where("record_id % 3 = 0"), p.where("status <> 'P'"))


@query("SELECT 'tags' AS stage, count(*) FILTER (status <> 'P' AND id % 4 <> 0) AS records FROM posts UNION ALL SELECT 'captions', count(*) FILTER (id % 4 = 0 AND rating <> 'e') FROM posts")
def a14_stage_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).select(F.when(c("status") != "P", "x").alias("source"), F.when(c("id") % 4 == 0, "x").alias("tag"), F.when(c("rating") == "e", "x").alias("caption"))
    return gate.stage_work(p, {"tags": ("source", "tag"), "captions": ("tag", "caption")})
