"""Queries of sources, sinks, lookups and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import norm
from tagloom.operators import classify, lookup, stats
from tagloom.plans.fixtures import posts, record_tags, sql, table, tag_categories
from tagloom.plans.registry import query
from tagloom.sources import io, snapshots
from tagloom.sources.shared import many, scratch, spread

c = F.col


def _df(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


FILES = """SELECT o_orderstatus AS folder, concat('Rec', cast(cast(floor(o_orderkey / 8) AS bigint) AS {string}), CASE o_orderkey % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.long.txt' WHEN 4 THEN '.Review.json' WHEN 5 THEN '.review.webp' WHEN 6 THEN '.csv' ELSE '.tag' END) AS name FROM {orders} GROUP BY 1, 2"""
_files = FILES.replace("{string}", "VARCHAR").replace("{orders}", "orders")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, FILES.replace("{string}", "string"), "orders")


@query(
    f"WITH f AS ({_files}), k AS (SELECT *, lower(name) AS l, regexp_replace(lower(name), '\\.[^.]*$', '') AS plain FROM f), i AS (SELECT DISTINCT folder, plain FROM k WHERE regexp_matches(l, '\\.(jpg|jpeg|png|webp)$')), "
    "s AS (SELECT k.*, CASE WHEN regexp_matches(l, '\\.(jpg|jpeg|png|webp)$') OR (folder, plain) IN (SELECT folder, plain FROM i) THEN plain ELSE regexp_replace(l, '(\\.review\\.json|\\.long\\.txt|\\.txt|\\.csv|\\.tag|\\.json)$', '') END AS record_id FROM k) SELECT folder, record_id, list_sort(list(name)) AS names FROM s GROUP BY 1, 2"
)
def a0a_bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.bundle_files(files(spark, sf_dir))


@query(f"WITH f AS ({_files}), k AS (SELECT folder, name, regexp_replace(lower(name), '\\.[^.]*$', '') AS stem FROM f WHERE regexp_matches(lower(name), '\\.(jpg|jpeg|png|webp)$')) SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY folder, stem) > 1")
def a0b_stem_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.stem_conflicts(files(spark, sf_dir))


TEXTS = """SELECT p_partkey AS id, concat(p_name, ', ', p_type, ' ,, x_', p_brand, chr(10), '#note, skipped', chr(10), upper(p_name), ',  b  c', chr(10), '# metadata: ', CASE p_partkey % 3 WHEN 0 THEN concat('{{"a": "', p_type, '"}}') WHEN 1 THEN '[1]' ELSE 'plain' END, chr(10), 'after, marker') AS text FROM {part}"""
_texts = TEXTS.replace("{{", "{").replace("}}", "}").replace("{part}", "part")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag texts (id, text), dealt out to all cores."""
    return spark.sql(TEXTS, part=spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey"))


@query(r"SELECT p_partkey AS id, [split_part(p_name, ',', 1), p_type, 'x_' || p_brand || chr(10) || '#note', 'skipped' || chr(10) || upper(p_name), 'b  c'] AS tags FROM part")
def a0c_read_source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", io.read_source_tags(c("text")).alias("tags"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS a FROM part")
def a0d_read_source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.element_at(io.read_source_metadata(c("text")), "a").alias("a"))


@query(f"SELECT folder, name FROM ({_files}) WHERE lower(name) LIKE '%.txt' AND lower(name) NOT LIKE '%.long.txt'")
def a0e_source_tag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(io.is_source_tag_file(c("name")))


@query("SELECT p_partkey AS id, list_sort(list_distinct([p_name, lower(p_type), 'x ' || lower(p_brand), 'b c'])) AS tags FROM part")
def a0f_read_dataset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", io.read_dataset_tags(c("text")).alias("tags"))


@query("SELECT min(p_partkey)::VARCHAR AS \"post id\", p_brand AS \"extra column\" FROM part GROUP BY p_brand")
def a0g_read_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file per brand, of which only the first row counts."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("Post_ID"), c("p_brand").alias("Extra Column"), c("p_brand").alias("brand"))
    rows.repartition("brand").sortWithinPartitions("brand", "Post_ID").write.partitionBy("brand").option("header", True).csv(path)
    return io.read_metadata(spark, path).select("post id", "extra column")


@query("WITH l AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE lower(p_brand) || '-' || p_partkey // 9 END AS label, p_partkey % 8 AS category FROM part) SELECT label, CASE WHEN trim(label) = '' THEN 'blank' WHEN count(*) > 1 THEN 'repeated' ELSE 'category' END AS reason FROM l GROUP BY 1 HAVING trim(label) = '' OR count(*) > 1 OR bool_or(category NOT IN (0, 4, 9))")
def a0h_validate_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.when(c("p_partkey") % 50 == 0, " ").otherwise(F.concat_ws("-", F.lower("p_brand"), F.expr("cast(p_partkey div 9 as string)"))).alias("label"), (c("p_partkey") % 8).alias("category"))
    return classify.validate_label_table(labels)


@query("SELECT 'long' AS kind, doc_id || '.long' AS name, text AS content FROM documents UNION ALL SELECT 'tag', doc_id || '.tag', source FROM documents WHERE doc_id % 2 = 0")
def a0i_export_training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by kind and read again."""
    path = scratch(spark)
    null = F.lit(None).cast("string")
    df = table(spark, sf_dir, "documents").select(c("doc_id").alias("record_id"), null.alias("combined"), c("text").alias("long"), null.alias("short"), F.when(c("doc_id") % 2 == 0, c("source")).alias("tag"))
    io.write_training_text(df, path)
    return spark.read.parquet(path).select("kind", "name", "content")


@query("SELECT tag, count(DISTINCT record_id)::VARCHAR AS images, count(DISTINCT record_id) FILTER (folder = 'A')::VARCHAR AS \"A\" FROM record_tags GROUP BY 1")
def a0j_export_tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read again."""
    path = scratch(spark)
    io.export_tag_stats(stats.tag_counts_by_folder(record_tags(spark, sf_dir), ["A"]), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT string_agg(DISTINCT replace(replace(p_name || ' (' || lower(p_type) || ')', '(', chr(92) || '('), ')', chr(92) || ')'), ', ' ORDER BY replace(replace(p_name || ' (' || lower(p_type) || ')', '(', chr(92) || '('), ')', chr(92) || ')')) AS line FROM part")
def a0k_candidate_tags_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")")).alias("name"))
    return io.candidate_tags_text(names)


@query("SELECT DISTINCT tag, category::BIGINT AS category FROM tag_categories")
def a0k_export_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and read again."""
    path = scratch(spark)
    io.export_candidates(tag_categories(spark, sf_dir), path)
    return spark.read.schema("tag string, category long").json(path)


@query("SELECT c_custkey AS record_id, 'old' AS kind FROM customer UNION ALL SELECT id, min(rating) FROM posts WHERE id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def a0l_write_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of customers, then the orders that it lacks, then those again."""
    path = scratch(spark)
    snapshots.create_missing(path, table(spark, sf_dir, "customer").select(c("c_custkey").alias("record_id"), F.lit("old").alias("kind")))
    for _ in range(2):
        snapshots.create_missing(path, posts(spark, sf_dir).select(c("id").alias("record_id"), c("rating").alias("kind")))
    return snapshots.read(spark, path)


OLD = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS v FROM {customer}"
NEW = "SELECT o_custkey + 300 AS k, min(o_orderpriority) AS v FROM {orders} GROUP BY 1"


@query(
    f"WITH o AS ({OLD.format(customer='customer')}), n AS ({NEW.format(orders='orders')}), j AS (SELECT coalesce(o.k, n.k) AS k, o.v AS a, n.v AS b, o.k IS NOT NULL AS ho, n.k IS NOT NULL AS hn FROM o FULL JOIN n ON o.k = n.k) "
    "SELECT 'replace' AS mode, k, CASE WHEN hn THEN b ELSE a END AS v FROM j UNION ALL SELECT 'ignore', k, CASE WHEN ho THEN a ELSE b END FROM j UNION ALL SELECT 'fill_blank', k, CASE WHEN NOT ho OR trim(a) = '' THEN coalesce(b, a) ELSE a END FROM j"
)
def a0m_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published as the second version of a snapshot, and read again."""
    old, new = sql(spark, sf_dir, OLD, "customer"), sql(spark, sf_dir, NEW, "orders")
    out = None
    for mode in ("replace", "ignore", "fill_blank"):
        path = scratch(spark)
        snapshots.publish(old, path)
        snapshots.upsert_into(path, new, ["k"], mode)
        part = snapshots.read(spark, path).select(F.lit(mode).alias("mode"), "k", "v")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT tag, category FROM tag_categories WHERE tag NOT IN ('brand#3', 'red', 'small')")
def a0n_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.delete_keys(tag_categories(spark, sf_dir), _df(spark, [(" Brand#3",), ("RED",), ("small_",), ("small",)], "tag string"))


@query("SELECT p_partkey AS id, 'a' AS first, p_type AS used, '' AS none FROM part")
def b2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(c("p_partkey").alias(" ID "), F.lit("a").alias("Tag_Name"), F.concat(F.lit(" "), "p_type").alias("The  Type"))
    h = norm.normalize_headers(df)
    return h.select("id", norm.get_column(h, "missing", "TAG NAME", "the type").alias("first"), norm.get_column(h, "the_type").alias("used"), norm.get_column(h, "nothing").alias("none"))


def captions_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions by a key that repeats, in files in the order of ids, beside files without captions, with other columns and other types."""
    path = scratch(spark)
    key = F.concat(F.lit(" "), F.upper(F.md5(F.expr("cast(doc_id div 3 as string)"))))
    d = table(spark, sf_dir, "documents").select("doc_id", key.alias("md5"), F.when(c("doc_id") % 7 == 0, " ").otherwise(c("text")).alias("caption"))
    d.repartitionByRange(many(spark), "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    d.select("md5", "doc_id").write.mode("append").parquet(path)
    d.select("md5", F.lit(7).alias("caption")).write.mode("append").parquet(path)
    return io.read_lookup_files(spark, path, "md5 string, caption string")


@query("WITH d AS (SELECT md5((doc_id // 3)::VARCHAR) AS md5, CASE WHEN doc_id % 7 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS caption, doc_id FROM documents) SELECT md5, arg_min(caption, doc_id) AS caption FROM d WHERE caption <> '' AND md5 IN (SELECT md5((c_custkey * 2)::VARCHAR) FROM customer) GROUP BY 1")
def d1_lookup_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.md5((c("c_custkey") * 2).cast("string")).alias("md5"))
    return lookup.lookup_captions(captions_in_files(spark, sf_dir), wanted)


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'S ' || doc_id END AS s, CASE WHEN doc_id % 3 = 0 THEN 'L ' || doc_id END AS l, CASE WHEN doc_id % 5 = 0 THEN 'S ' || doc_id END AS t, '# ' AS h, chr(10) || chr(10) AS n, doc_id % 7 = 0 AS v, doc_id % 11 = 0 AS ch FROM documents), "
    "r AS (SELECT 'n' || doc_id AS name, concat_ws(n, '# Analysis' || n || coalesce(s, l, t), '# Long' || n || CASE WHEN s IS NOT NULL THEN l END, '# Summary' || n || CASE WHEN s IS NULL AND l IS NOT NULL THEN t END, CASE WHEN v THEN '# Mood' || n || 'v' END, CASE WHEN ch THEN '# Tags' || n || 'a, b' END) AS report FROM d WHERE coalesce(s, l, t) IS NOT NULL) SELECT name, report FROM r"
)
def d2_reconstruct_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("doc_id")
    text = lambda n, k, v: F.when(i % k == 0, F.concat(F.lit(v), i.cast("string"))).alias(n)
    df = table(spark, sf_dir, "documents").select(F.concat(F.lit("N"), i.cast("string")).alias("name"), F.lit(" ").alias("s1"), text("s2", 2, "S "), text("l1", 3, "L "), text("short", 5, "S "), F.when(i % 7 == 0, "v").alias("vibes"), F.when(i % 11 == 0, F.array(F.lit("a"), F.lit("b"))).alias("chars"), F.lit("f").alias("_file"), i.alias("_row"))
    return lookup.reconstruct_reports(df, ["s1", "s2"], ["l1"], "short", ("Analysis", "Long", "Summary"), [("vibes", "Mood")], [("chars", "Tags")])


# A heading and a section of prompts, as arguments of the operator.
HEADINGS, SECTIONS = ("<report>\n# Analysis",), (("\nOriginal:\n", "\nEnd of prompt."),)


def canonical(p: Column) -> Column:
    return lookup.canonical_prompt(p, HEADINGS, SECTIONS)


def _image(n: str) -> Column:
    return F.md5(F.expr(f"cast(doc_id div {n} as string)"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four entries for an image; those of even ids have a credit and other line breaks in their prompts."""
    i = c("doc_id")
    prompt = F.concat(F.lit("Look at "), F.expr("cast(doc_id div 4 as string)"), F.when(i % 2 == 0, "\r\nOriginal:\r\n Drawn by @someone. a scene \r\nEnd of prompt.").otherwise("\nOriginal:\na scene\nEnd of prompt."))
    df = table(spark, sf_dir, "documents").select(_image("4").alias("image_hash"), F.when(i % 4 == 0, "spatial").otherwise("long").alias("caption_kind"), F.lit("m").alias("model"), prompt.alias("prompt"), F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit("cap "), i.cast("string"))).alias("caption"), i.alias("seq"))
    return df.withColumn("cache_key", lookup.cache_key(c("image_hash"), c("caption_kind"), c("model"), c("prompt"))).select("cache_key", "image_hash", "caption_kind", "model", "prompt", "caption", "seq")


@query(
    r"WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents) SELECT doc_id AS id, 'Look' || chr(10) || '<report>' || chr(10) || '# Analysis ' || chr(10) || chr(10) || t || chr(10) || 'Original:' || chr(10) || regexp_replace(t, '^\s+|\s+$', '', 'g') || chr(10) || 'End of prompt.' AS prompt FROM d"
)
def d4_canonical_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Look\r\n<report>\r# Analysis \r\n \n\n"), "text", F.lit("\r\nOriginal:\n  Drawn by @a, @b. Drawn by @c.\n"), "text", F.lit(" \n\nEnd of prompt."))
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), canonical(t).alias("prompt"))


@query(
    "WITH d AS (SELECT doc_id AS seq, doc_id // 4 AS h, doc_id % 2 = 0 AS credited FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 4 <> 0), q AS (SELECT DISTINCT doc_id // 3 AS h FROM documents), "
    "m AS (SELECT q.h AS request_id, CASE WHEN NOT credited THEN 0 ELSE 2 END AS tier, seq FROM q JOIN d ON d.h = q.h), b AS (SELECT request_id, min(tier) AS tier FROM m GROUP BY 1) "
    "SELECT q.h AS request_id, b.tier, 'cap ' || max(seq) AS caption FROM q LEFT JOIN b ON b.request_id = q.h LEFT JOIN m ON m.request_id = q.h AND m.tier = b.tier GROUP BY 1, 2"
)
def d3_resolve_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("request_id")).distinct()
    prompt = F.concat(F.lit("Look at "), c("request_id").cast("string"), F.lit("\nOriginal:\n Drawn by @b.\na scene\nEnd of prompt."))
    r = r.select("request_id", F.md5(c("request_id").cast("string")).alias("image_hash"), F.lit("long").alias("caption_kind"), F.lit("m").alias("model"), prompt.alias("prompt"))
    return lookup.resolve_cached(r, _cache(spark, sf_dir), canonical).select("request_id", "tier", "caption")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id // 4, doc_id % 4 = 0, doc_id % 2 FROM documents)) + count(DISTINCT doc_id) AS rows, count(DISTINCT doc_id) AS seeded FROM documents")
def d5_seed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    cache = cache.groupBy("cache_key").agg(*[F.max_by(n, "seq").alias(n) for n in cache.columns if n != "cache_key"])
    r = table(spark, sf_dir, "documents").select(c("doc_id").alias("request_id")).distinct()
    r = r.select("request_id", F.md5(F.concat(F.lit("new "), c("request_id").cast("string"))).alias("image_hash"), F.lit("long").alias("caption_kind"), F.lit("m").alias("model"), F.lit("p").alias("prompt"))
    found = r.select(c("image_hash").alias("md5"), F.lit("seed b").alias("caption")).unionAll(r.select("image_hash", F.lit("seed a")))
    out = lookup.seed_cache(cache, r, found, canonical)
    return out.agg(F.count("*").alias("rows"), F.count_if(c("caption") == "seed a").alias("seeded"))


@query(
    "WITH d AS (SELECT doc_id AS seq, doc_id // 4 AS h, doc_id % 4 = 0 AS spatial, doc_id % 2 AS cr, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'cap ' || doc_id END AS caption FROM documents), k AS (SELECT h, spatial, cr, arg_max(caption, seq) AS caption FROM d GROUP BY ALL) "
    "SELECT md5(h::VARCHAR) AS image_hash, caption FROM k UNION ALL SELECT md5('new ' || h), caption FROM k WHERE NOT spatial AND h % 5 < 2"
)
def d6_alias_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    newest = cache.groupBy("cache_key").agg(*[F.max_by(n, "seq").alias(n) for n in cache.columns if n != "cache_key"])
    pairs = table(spark, sf_dir, "documents").select(F.expr("cast(doc_id div 4 as string)").alias("h")).distinct().where("h % 5 < 2").select(F.md5("h").alias("old"), F.md5(F.concat(F.lit("new "), "h")).alias("new"))
    return lookup.alias_cache(newest.select(*cache.columns), pairs).select("image_hash", "caption")


@query(
    "WITH p AS (SELECT p_partkey AS md5, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 10 <> 1 THEN p_size * 100 END AS w, p_size * 60 + p_partkey % 700 AS h FROM part), s AS (SELECT *, greatest(w, h) AS l, least(w, h) AS s, least(1.0::DOUBLE, 3000.0::DOUBLE / greatest(w, h)) AS f FROM p) SELECT md5, w AS width, h AS height FROM s WHERE w IS NULL OR w = 0 OR l * f > 2000 OR s * f > 1500"
)
def d7_upgrade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sizes are zero or missing."""
    p, i = table(spark, sf_dir, "part"), c("p_partkey")
    remote = p.select(i.alias("md5"), F.when(i % 10 == 0, 0).when(i % 10 != 1, c("p_size") * 100).alias("width"), (c("p_size") * 60 + i % 700).alias("height"))
    return lookup.upgrade_candidates(p.select(i.alias("md5"), F.lit(1500).alias("width"), F.lit(2000).alias("height")), remote)


@query("SELECT o_custkey AS md5, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS source_no, CASE WHEN o_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS v FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 3 = 0 OR o_custkey % 2 = 0")
def d8_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select(c("o_custkey").alias("md5"))
    return lookup.first_source(k, [k.distinct().where("md5 % 3 = 0").withColumn("v", F.lit("first")), k.distinct().where("md5 % 2 = 0").withColumn("v", F.lit("second"))])
