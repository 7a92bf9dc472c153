"""The driver's tables in the roles of records, tags, posts and captions, once for Spark and once as oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Run SQL over driver tables without registering views: {name} stands for a table."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


RECORD_TAGS = """
  SELECT record_id, folder, 4 * rn + s AS pos, CASE s WHEN 0 THEN lower(p_brand) WHEN 1 THEN lower(p_type) WHEN 2 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS tag
  FROM (SELECT l_orderkey AS record_id, l_returnflag AS folder, p_brand, p_type, p_name,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) x
  CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) y"""
CATEGORIES = """
  SELECT DISTINCT * FROM (SELECT lower(p_brand) AS tag, 1 AS category FROM {part} WHERE p_brand <> 'Brand#25'
  UNION ALL SELECT lower(p_type), 5 FROM {part} UNION ALL SELECT split_part(p_name, ' ', 1), 0 FROM {part} UNION ALL SELECT split_part(p_name, ' ', 2), 4 FROM {part}) z"""
POSTS = """
  SELECT o_orderkey AS id, md5(cast(o_orderkey AS {string})) AS md5, o_custkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'e' WHEN '2-HIGH' THEN 'q' WHEN '3-MEDIUM' THEN 's' WHEN '4-NOT SPECIFIED' THEN 'g' ELSE 'general' END AS rating,
    o_totalprice / 1500 - 20 AS score, concat(cast(2009 + 2 * (year(o_orderdate) - 1995) AS {string}), '-06-01T00:30:00+05:00') AS created_at, o_orderstatus AS status
  FROM {orders}"""


# The same, four tags to a line and the lines of a record gathered once.
TAG_LINES = """
  SELECT l_orderkey AS record_id, array(lower(p_brand), lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS tags, struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS at
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
TAG_LISTS = f"""
  SELECT record_id, flatten(lines.tags) AS tags
  FROM (SELECT record_id, sort_array(collect_list(struct(at, tags))) AS lines FROM ({TAG_LINES}) x GROUP BY record_id) y"""


def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, tags, at): the tags of a record in parts"""
    return sql(spark, sf_dir, TAG_LINES, "lineitem", "part")


def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, tags): the tags of record_tags in the row of their record, in the order of pos"""
    return sql(spark, sf_dir, TAG_LISTS, "lineitem", "part")


def record_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, folder, pos, tag)"""
    return sql(spark, sf_dir, RECORD_TAGS, "lineitem", "part")


def tag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, category); one brand is left out"""
    return sql(spark, sf_dir, CATEGORIES, "part")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, md5, o_custkey, rating, score, created_at, status)"""
    return sql(spark, sf_dir, POSTS.replace("{string}", "string"), "orders")


def oracle(text: str) -> str:
    """Oracle SQL with the fixtures it names as common table expressions."""
    parts = {"record_tags": RECORD_TAGS, "tag_categories": CATEGORIES, "posts": POSTS}
    named = ", ".join(f"{n} AS ({s.format(lineitem='lineitem', part='part', orders='orders', string='VARCHAR')})" for n, s in parts.items() if n in text)
    body = text.strip()
    if not named:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {named}, {body[15:]}"
    return f"WITH {named}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {named} {body}"
