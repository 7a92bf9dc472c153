"""Queries of quotas and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import fill, quota
from tagloom.plans.fixtures import record_tags, sql, table, tag_categories
from tagloom.plans.registry import query

c = F.col


def _df(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with four name words as safety tags; an order's customer key is the identity of some."""
    rt = record_tags(spark, sf_dir).select(F.concat(F.lit("p"), F.expr("record_id div 3")).alias("identity"), F.when(c("tag") == "hot", "explicit").when(c("tag") == "cold", "nsfw").when(c("tag") == "red", "sensitive").when(c("tag") == "blue", "safe").otherwise(c("tag")).alias("tag"))
    return quota.quota_snapshot(rt, "ring")


SNAP = """rt AS (SELECT DISTINCT 'p' || record_id // 3 AS identity, CASE tag WHEN 'hot' THEN 'explicit' WHEN 'cold' THEN 'nsfw' WHEN 'red' THEN 'sensitive' WHEN 'blue' THEN 'safe' ELSE tag END AS tag FROM record_tags),
 own AS (SELECT identity, CASE WHEN bool_or(tag = 'explicit') THEN 'e' WHEN bool_or(tag = 'nsfw') THEN 'q' WHEN bool_or(tag = 'sensitive') THEN 's' WHEN bool_or(tag = 'safe') THEN 'g' END AS stratum, bool_or(tag = 'ring') AS flag FROM rt GROUP BY 1),
 x AS (SELECT tag, stratum, flag FROM rt JOIN own USING (identity)),
 snap AS (SELECT tag, NULL AS stratum, NULL::BOOLEAN AS flag, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT tag, stratum, NULL, count(*) FROM x WHERE stratum IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT tag, NULL, true, count(*) FROM x WHERE flag GROUP BY 1 UNION ALL SELECT tag, stratum, true, count(*) FROM x WHERE flag AND stratum IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {SNAP} SELECT * FROM snap")
def e7_quota_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir)


REQUESTS = "SELECT DISTINCT split_part(p_name, ' ', 2) AS tag, s AS stratum, 300 + length(p_name) AS target FROM {part} CROSS JOIN (SELECT 'e' AS s UNION ALL SELECT 'g' UNION ALL SELECT 'x') y"


@query(f"WITH {SNAP}, r AS ({REQUESTS.format(part='part')}) SELECT r.*, greatest(0, target - coalesce(n, 0) - CASE WHEN r.tag = 'gear' THEN 7 ELSE 0 END) AS gap FROM r LEFT JOIN (SELECT * FROM snap WHERE flag IS NULL) s ON r.tag = s.tag AND r.stratum = s.stratum")
def e8_quota_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sql(spark, sf_dir, REQUESTS, "part")
    filled = r.where("tag = 'gear'").select("tag", "stratum", F.lit(7).alias("n")).distinct()
    return quota.quota_gap(r, snapshot(spark, sf_dir).where("flag is null"), filled)


# Orders as posts of two sources, which share some files, with the tags of their first lines; requests for name words, by
# rating, for posts with one tag, or with a score. What is wanted grows with the table.
FILL_POSTS = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'two' ELSE 'one' END AS source, o_orderkey AS id, md5(cast(o_orderkey - CASE WHEN o_orderkey % 9 = 3 THEN 3 WHEN o_orderkey % 9 = 4 THEN 1 ELSE 0 END AS {string})) AS md5,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'e' WHEN '2-HIGH' THEN 'q' ELSE 'g' END AS rating, cast(floor(o_totalprice / 1500) AS double) AS score FROM {orders}"""
FILL_REQUESTS = """SELECT cast(row_number() OVER (ORDER BY word, kind, source DESC) AS int) AS seq, source, word AS tag, CASE kind WHEN 1 THEN 'e' WHEN 2 THEN 'g' END AS stratum, kind = 3 AS flag, CASE WHEN kind = 4 THEN 100 END AS min_score, cast(posts // (150 + 50 * kind) AS int) AS gap
 FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM {part}), (SELECT count(*) AS posts FROM {orders}), (SELECT unnest(range(5)) AS kind), (SELECT unnest(['one', 'two']) AS source)"""
_fill = FILL_POSTS.replace("{string}", "VARCHAR").replace("{orders}", "orders")
_wanted = FILL_REQUESTS.replace("{part}", "part").replace("{orders}", "orders")


# One step for a request: what of the posts taken so far counts for it, then the first that are left.
@query(
    f"""WITH RECURSIVE p AS MATERIALIZED ({_fill}), r AS MATERIALIZED ({_wanted}), l AS (SELECT record_id AS id, tag FROM record_tags GROUP BY 1, 2), own AS (SELECT id FROM l WHERE tag = 'ring'),
 m AS MATERIALIZED (SELECT seq, gap, p.*, r.source = p.source AND coalesce(score >= min_score, true) AND md5 NOT IN (SELECT md5(c_custkey::VARCHAR) FROM customer) AS offered FROM p JOIN l USING (id) JOIN r USING (tag) WHERE (stratum IS NULL OR stratum = rating) AND (NOT flag OR id IN (FROM own))),
 s(k, seq, id, md5, rank) AS (SELECT 0, 0, NULL::BIGINT, NULL::VARCHAR, 0 UNION ALL SELECT * FROM (
  SELECT k + 1, seq, id, md5, rank FROM s WHERE k < (SELECT max(seq) FROM r) UNION ALL
  SELECT seq, seq, id, md5, n FROM (SELECT seq, id, md5, gap, (row_number() OVER (ORDER BY score DESC, id))::INT AS n FROM (SELECT seq, md5, arg_min(id, (-score, id)) AS id, max(score) AS score, max(gap) AS gap FROM m WHERE offered AND seq = (SELECT max(k) + 1 FROM s) AND md5 NOT IN (SELECT s.md5 FROM s WHERE s.md5 IS NOT NULL) GROUP BY ALL))
   WHERE n <= gap - (SELECT count(*) FROM m WHERE m.seq = (SELECT max(k) + 1 FROM s) AND m.id IN (SELECT s.id FROM s))) y)
 SELECT s.seq, p.source, p.id, p.md5, p.score, s.rank FROM s JOIN p USING (id) WHERE k = (SELECT max(seq) FROM r)"""
)
def e9_fill_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = record_tags(spark, sf_dir).groupBy(c("record_id").alias("id")).agg(F.collect_set("tag").alias("tags"))
    p = sql(spark, sf_dir, FILL_POSTS.replace("{string}", "string"), "orders").join(tags, "id")
    have = table(spark, sf_dir, "customer").select(F.md5(c("c_custkey").cast("string")).alias("md5"))
    wanted = sql(spark, sf_dir, FILL_REQUESTS.replace("posts // (", "posts div (").replace("unnest(range(5))", "explode(sequence(0, 4))").replace("unnest(['one', 'two'])", "explode(array('one', 'two'))"), "part", "orders")
    return fill.fill_requests(wanted, p, have, "ring")


@query(
    "SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN md5(o_custkey::VARCHAR) END AS md5, min(o_orderpriority) AS kind FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1 "
    "UNION ALL SELECT 0, md5(o_custkey::VARCHAR), min(o_orderpriority) FROM orders WHERE o_custkey % 14 = 0 GROUP BY o_custkey UNION ALL SELECT DISTINCT NULL, '', o_orderpriority || o_custkey FROM orders WHERE o_custkey % 14 = 7"
)
def e10_dedupe_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with an id, with an md5 alone, and with neither."""
    md5 = F.md5(c("o_custkey").cast("string"))
    seven, even = c("o_custkey") % 7 == 0, c("o_custkey") % 2 == 0
    id_, kind = F.when(~seven, c("o_custkey")).when(even, 0), F.when(seven & ~even, F.concat("o_orderpriority", c("o_custkey").cast("string"))).otherwise(c("o_orderpriority"))
    return quota.dedupe_posts(table(spark, sf_dir, "orders").select(id_.alias("id"), F.when(even, md5).when(seven, "").alias("md5"), kind.alias("kind")))


@query(
    f"WITH {SNAP}, t AS (SELECT DISTINCT tag FROM record_tags), w AS (SELECT * FROM t, (SELECT 'e' AS stratum, 900 AS target UNION ALL SELECT 'g', 20) y), "
    "m AS (SELECT w.tag, string_agg(w.stratum || ':' || target, ',' ORDER BY w.stratum) FILTER (coalesce(n, 0) < target) AS missing FROM w LEFT JOIN (SELECT * FROM snap WHERE flag IS NULL) s ON w.tag = s.tag AND w.stratum = s.stratum GROUP BY 1), "
    "a AS (SELECT m.*, coalesce(max(n) FILTER (flag IS NULL AND stratum IS NULL), 0) AS current, coalesce(max(n) FILTER (flag AND stratum IS NULL), 0) AS flagged FROM m LEFT JOIN snap USING (tag) GROUP BY ALL) "
    "SELECT tag, current, coalesce(missing, '') AS missing, CASE WHEN flagged < 1500 THEN 1500 ELSE 0 END AS flag_target FROM a WHERE missing IS NOT NULL OR flagged < 1500"
)
def e11_underfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quota.underfilled(record_tags(spark, sf_dir), snapshot(spark, sf_dir), {"e": 900, "g": 20}, flag_target=1500)
    return df.select("tag", "current", F.array_join(F.array_sort(F.transform(F.map_entries("missing"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",").alias("missing"), "flag_target")


@query("WITH v AS (SELECT o_custkey AS tag_id, min(o_orderdate) AS first FROM orders GROUP BY 1) SELECT c_custkey AS tag_id FROM customer LEFT JOIN v ON c_custkey = tag_id WHERE first IS NULL OR first >= TIMESTAMP '1995-04-01'")
def e12_history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(c("o_custkey").alias("tag_id"), c("o_orderdate").alias("created_at"))
    return quota.history_filter(table(spark, sf_dir, "customer").select(c("c_custkey").alias("tag_id")), versions, F.lit("1995-04-01").cast("timestamp"))


@query("WITH v AS (SELECT o_custkey AS tag, min(o_orderdate) AS first FROM orders GROUP BY 1) SELECT c_custkey AS tag FROM customer JOIN v ON c_custkey = tag WHERE first BETWEEN TIMESTAMP '1995-02-01' AND TIMESTAMP '1996-01-01'")
def e13_oldest_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(c("o_custkey").alias("tag"), c("o_orderdate").alias("created_at"))
    return quota.oldest_post_filter(table(spark, sf_dir, "customer").select(c("c_custkey").alias("tag")), p, F.lit("1995-02-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))


@query(
    "WITH e AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, CASE WHEN p_size > 25 THEN 'active' ELSE 'deleted' END AS s FROM part) SELECT DISTINCT tag FROM tag_categories WHERE tag NOT IN (SELECT a FROM e WHERE s = 'active' AND b IN (SELECT tag FROM tag_categories WHERE category = 4))"
)
def e14_exclude_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("antecedent"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("consequent"), F.when(c("p_size") > 25, "active").otherwise("deleted").alias("status"))
    cats = tag_categories(spark, sf_dir)
    return quota.exclude_variants(cats.select("tag").distinct(), edges, cats)


@query(
    "WITH t AS (SELECT DISTINCT tag FROM tag_categories), s AS (SELECT 'one' AS source UNION ALL SELECT 'two') SELECT source, tag, stratum, false AS flag, target FROM t, s, (SELECT 'e' AS stratum, 5 AS target UNION ALL SELECT 'g', 9) x UNION ALL SELECT source, tag, NULL, true, 3 FROM t, s"
)
def e15_expand_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = tag_categories(spark, sf_dir).select("tag").distinct().withColumn("missing", F.create_map(F.lit("e"), F.lit(5), F.lit("g"), F.lit(9)))
    return quota.expand_requests(cands, ["one", "two"], 3)


@query(
    "WITH o AS (SELECT DISTINCT p_name AS n, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), k AS (SELECT CASE WHEN a < b THEN a || ' ' || b ELSE b || ' ' || a END AS identity, a, b, n FROM o) "
    "SELECT 'one' AS source, identity, CASE WHEN a = 'red' THEN 5 WHEN a = 'blue' AND b < 'h' THEN 50 WHEN a = 'hot' THEN 50 ELSE 7 END AS target, a <> 'red' AS owned, CASE WHEN a = 'red' THEN 'keep' WHEN a = 'blue' AND b < 'h' THEN 'refresh' WHEN a = 'hot' THEN 'insert' ELSE 'keep' END AS action FROM k"
)
def e16_merge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old requests for all names but `hot`, manual ones for `red`; new ones, words turned round, for hot, red, some blue."""
    n = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    old = n.where("a <> 'hot'").select(F.lit("one").alias("source"), c("p_name").alias("tags"), F.when(c("a") == "red", 5).otherwise(7).alias("target"), (c("a") != "red").alias("owned"))
    new = n.where("a in ('hot', 'red') or (a = 'blue' and b < 'h')").select(F.lit("one").alias("source"), F.concat_ws("  ", "b", "a").alias("tags"), F.lit(50).alias("target"))
    return quota.merge_requests(old, new)


QUERIES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'three' ELSE 'one' END AS source, cast(o_orderkey % 4 AS int) AS target, CASE WHEN o_orderkey % 6 = 0 THEN 'finished' ELSE 'waiting' END AS status,
 concat(CASE o_orderkey % 7 WHEN 0 THEN 'Tag_a rating:safe score:>=5' WHEN 1 THEN 'tag_a official_art order:score' WHEN 2 THEN 'a b' WHEN 3 THEN '-tag_a' WHEN 4 THEN 'tag_a score:3 score:4' WHEN 5 THEN 'official_art' ELSE 'tag_a score:<-2 rating:e' END, ' ') AS query FROM {orders}"""
_queries = QUERIES.format(orders="orders")


@query(
    f"WITH q AS ({_queries}), v AS (SELECT *, id % 7 IN (0, 1, 5, 6) AS valid FROM q WHERE status <> 'finished') SELECT source, query, target, CASE WHEN source <> 'one' THEN 'source' WHEN target < 1 THEN 'target' WHEN NOT valid THEN 'query' ELSE 'pending' END AS reason, count(*) AS n FROM v GROUP BY ALL"
)
def e16a_pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = quota.pending_requests(sql(spark, sf_dir, QUERIES, "orders").drop("id"), ["one", "two"])
    every = good.select("source", "query", "target", F.lit("pending").alias("reason")).unionAll(bad)
    return every.groupBy("source", "query", "target", "reason").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT DISTINCT lower(p_type) AS tag FROM part UNION SELECT DISTINCT lower(p_brand) FROM part) SELECT source, tag, NULL::VARCHAR AS stratum, false AS flag, target FROM t, (SELECT 'one' AS source, 10 AS target UNION ALL SELECT 'two', 20) s")
def e16b_requests_for_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tags = p.select(F.concat(F.lit(" "), "p_type").alias("tag")).unionAll(p.select("p_brand")).unionAll(p.select("p_name")).unionAll(p.select(F.concat(F.lit("-"), "p_type"))).unionAll(p.select(F.concat("p_type", F.lit("*"))))
    return quota.requests_for_tags(tags, {"one": 10, "two": 20})


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def e17_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.outcome_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome"))


@query(
    "WITH e AS (SELECT count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'error') AS t, coalesce(sum(value), 0) AS v FROM events) SELECT p AS processed, s AS skipped, t AS truncated, round(100.0 * p / 1000000, 0)::DOUBLE AS percent, round(CASE WHEN p > 0 THEN v / p ELSE 0 END, 3) AS average, round(CASE WHEN p > 0 THEN v / p ELSE 0 END * greatest(0, 1000000 - p), 1) AS remaining FROM e"
)
def e18_progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.when(c("event_type") == "view", "processed").when(c("event_type") == "click", "skipped").when(c("event_type") == "error", "truncated").alias("outcome"), c("value").alias("seconds"))
    return quota.progress_report(log, 1_000_000)


@query("SELECT o_orderkey AS record_id, o_orderpriority AS name, doc_id IS NOT NULL AS has_caption FROM orders LEFT JOIN (SELECT doc_id FROM documents) ON doc_id = o_orderkey")
def e19_order_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.order_pending(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("record_id"), c("o_orderpriority").alias("name")), table(spark, sf_dir, "documents").select(c("doc_id").alias("record_id")))


@query("SELECT count(*) AS accepted FROM (SELECT DISTINCT record_id FROM record_tags)")
def e7g_require_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot is only made if the rejects are empty."""
    rt = record_tags(spark, sf_dir)
    quota.require_clean(rt.where("tag is null"))
    return rt.select("record_id").distinct().agg(F.count("*").alias("accepted"))
