"""Keyed lookups: captions, wide reports, caches, sources in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.norm import strip
from tagloom.functions.text import strip_credit
from tagloom.sources.io import upsert


def lookup_captions(df: DataFrame, wanted: DataFrame | None = None, key: str = "md5", text: str = "caption") -> DataFrame:
    """(md5, caption): the first non-empty text of each key in (_file, _row) order; keys trimmed and lower-cased.

    df is what `sources.io.read_lookup_files` gives. Null keys and texts give nothing.
    """
    k, t = F.lower(strip(F.col(key))), strip(F.col(text))
    rows = df.select(k.alias("md5"), t.alias("caption"), "_file", "_row").where("md5 <> '' and caption <> ''")
    if wanted is not None:
        rows = rows.join(wanted.select(F.lower(F.trim("md5")).alias("md5")).distinct(), "md5", "left_semi")
    return rows.groupBy("md5").agg(F.min_by("caption", F.struct("_file", "_row")).alias("caption"))


def reconstruct_reports(df: DataFrame, structured: list[str], long: list[str], short: str, headings: tuple[str, str, str], extra: list[tuple[str, str]], lists: list[tuple[str, str]], wanted: DataFrame | None = None) -> DataFrame:
    """(name, report) from sparse columns, in sections with a heading each.

    The first section has the first non-empty structured text, or else the long one, or the short one; without any of them
    there is no report. Then come the first long and the short text, each unless an earlier section has it, then extra columns and
    list columns (joined by commas) under their headings: (column, heading). The first row with a report wins.
    """
    text = lambda n: F.nullif(strip(F.col(n)), F.lit(""))
    x, y, z = F.coalesce(*map(text, structured)), F.coalesce(*map(text, long)), text(short)
    section = lambda h, t: F.concat(F.lit(f"# {h}\n\n"), t)
    main = F.coalesce(x, y, z)
    parts = [section(headings[0], main), section(headings[1], F.when(y != main, y)), section(headings[2], F.when((z != main) & ~z.eqNullSafe(y), z))]
    parts += [section(h, text(n)) for n, h in extra] + [section(h, F.when(F.size(F.col(n)) > 0, F.array_join(n, ", "))) for n, h in lists]
    report = F.when(main.isNotNull(), strip(F.array_join(F.array_compact(F.array(*parts)), "\n\n")))
    rows = df.select(F.lower(strip(F.col("name"))).alias("name"), report.alias("report"), "_file", "_row").where("name <> '' and report <> ''")
    if wanted is not None:
        rows = rows.join(wanted.select(F.lower(strip(F.col("name"))).alias("name")).distinct(), "name", "left_semi")
    return rows.groupBy("name").agg(F.min_by("report", F.struct("_file", "_row")).alias("report"))


def canonical_prompt(c: Column, headings: tuple[str, ...] = (), sections: tuple[tuple[str, str], ...] = ()) -> Column:
    """What a prompt says, without differences of presentation; scene text stays as it is.

    One kind of line break; after a heading line (of one or more lines) exactly one blank line where there are any; and the
    text between the two strings of a section, which the second ends, trimmed and without credits of @ names.
    """
    t = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for h in headings:
        t = F.regexp_replace(t, rf"(\Q{h}\E[ \t]*\n)(?:[ \t]*\n)+", "$1\n")
    for before, after in sections:
        start = F.instr(t, before) + len(before)
        size = F.length(t) - len(after) - start + 1
        inner = strip_credit(F.regexp_replace(F.substring(t, start, size), r"^\s+|\s+$", ""))
        fits = (F.instr(t, before) > 0) & (size >= 0) & F.endswith(t, F.lit(after))
        t = F.when(fits, F.concat(F.left(t, start - 1), inner, F.lit(after))).otherwise(t)
    return t


def cache_key(image_hash: Column, kind: Column, model: Column, prompt: Column) -> Column:
    """SHA-256 of the bytes of the image's hash, then kind, model and prompt, each after a zero; null if any is null."""
    return F.sha2(F.concat(F.unhex(image_hash), F.encode(F.concat(*[x for p in (kind, model, prompt) for x in (F.lit("\u0000"), p)]), "UTF-8")), 256)


def resolve_cached(requests: DataFrame, cache: DataFrame, canonical: Callable[[Column], Column] = canonical_prompt) -> DataFrame:
    """D3: requests (request_id, image_hash, caption_kind, model, prompt) with the cached caption, if any, and its tier.

    Tier 0: the key over the canonical prompt; 1: over the prompt as it is; 2: the newest entry of the same image, kind
    and model. In all of them the entry's own image, kind, model and canonical prompt must be the request's, since a key
    may have been made by other rules. Blank captions never hit.
    """
    c = cache.where(strip(F.col("caption")) != "")
    r = requests.select("request_id", "image_hash", "caption_kind", "model", "prompt", canonical(F.col("prompt")).alias("_c"))
    part = ("image_hash", "caption_kind", "model")
    key = lambda p: cache_key(*[F.col(x) for x in part], F.col(p))
    keys = r.select("request_id", F.explode(F.array(F.struct(F.lit(0).alias("tier"), key("_c").alias("k")), F.struct(F.lit(1).alias("tier"), key("prompt").alias("k")))).alias("x")).select("request_id", "x.tier", F.col("x.k").alias("cache_key"))
    stored = c.select("cache_key", "seq", "caption", *[F.col(x).alias(f"_{x}") for x in part], canonical(F.col("prompt")).alias("_p"))
    met = keys.join(stored, "cache_key").join(r.drop("prompt"), "request_id")
    by_key = met.where((F.col("_p") == F.col("_c")) & (F.col("_image_hash") == F.col("image_hash")) & (F.col("_caption_kind") == F.col("caption_kind")) & (F.col("_model") == F.col("model"))).select("request_id", "tier", "seq", "caption")
    same = r.withColumnRenamed("_c", "_p").join(c.select(*part, canonical(F.col("prompt")).alias("_p"), "seq", "caption"), [*part, "_p"]).select("request_id", F.lit(2).alias("tier"), "seq", "caption")
    best = by_key.unionAll(same).groupBy("request_id").agg(F.min_by(F.struct("tier", "caption"), F.struct("tier", -F.col("seq"))).alias("b"))
    return requests.join(best, "request_id", "left").select(*requests.columns, F.col("b.tier").alias("tier"), F.col("b.caption").alias("caption"))


def seed_cache(cache: DataFrame, requests: DataFrame, captions: DataFrame, canonical: Callable[[Column], Column] = canonical_prompt) -> DataFrame:
    """Cache rows for requests that miss it and whose image has a looked-up caption (md5, caption); of several, the least."""
    missing = resolve_cached(requests, cache, canonical).where("caption is null").drop("caption", "tier")
    rows = missing.join(captions.select(F.col("md5").alias("image_hash"), "caption"), "image_hash")
    rows = rows.select(cache_key(F.col("image_hash"), F.col("caption_kind"), F.col("model"), canonical(F.col("prompt"))).alias("cache_key"), "image_hash", "caption_kind", "model", "prompt", "caption")
    return upsert(cache.drop("seq"), rows.groupBy("cache_key").agg(F.min(F.struct(*[c for c in rows.columns if c != "cache_key"])).alias("r")).select("cache_key", "r.*"), ["cache_key"], "ignore")


def alias_cache(cache: DataFrame, pairs: DataFrame, skip_kind: str = "spatial") -> DataFrame:
    """Cache with the entries of old hashes copied to new ones (old, new), but for one kind; only blanks are filled."""
    copies = cache.where(F.col("caption_kind") != skip_kind).join(pairs, F.col("image_hash") == F.col("old"))
    copies = copies.select(cache_key(F.col("new"), F.col("caption_kind"), F.col("model"), F.col("prompt")).alias("cache_key"), F.col("new").alias("image_hash"), "caption_kind", "model", "prompt", "caption", "seq")
    newest = copies.groupBy("cache_key").agg(*[F.max_by(c, "seq").alias(c) for c in copies.columns if c not in ("cache_key", "seq")])
    return upsert(cache.drop("seq"), newest.select(*[c for c in cache.columns if c != "seq"]), ["cache_key"], "fill_blank")


def upgrade_candidates(local: DataFrame, posts: DataFrame, edge: int = 3000) -> DataFrame:
    """(md5, width, height) of posts that may be larger than the local image.

    They are if the longer or the shorter edge, scaled so that the longer one is at most `edge`, exceeds the local one. Sizes
    that are missing or not positive are unknown, and such posts stay.
    """
    df = local.select("md5", F.greatest("width", "height").alias("_l"), F.least("width", "height").alias("_s")).join(posts.select("md5", "width", "height"), "md5")
    long, short = F.greatest("width", "height").cast("double"), F.least("width", "height").cast("double")
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(float(edge)), long))
    known = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    larger = (long * scale > F.col("_l")) | (short * scale > F.col("_s"))
    return df.where(~known | F.coalesce(larger, F.lit(True))).select("md5", "width", "height")


def first_source(wanted: DataFrame, sources: list[DataFrame], key: str = "md5") -> DataFrame:
    """For each wanted key the row of the first source that has it, with the source's number."""
    every = None
    for i, s in enumerate(sources):
        part = s.withColumn("_p", F.lit(i))
        every = part if every is None else every.unionByName(part)
    cols = [c for c in every.columns if c != "_p"]
    best = every.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(F.struct("_p", *[c for c in cols if c != key])).alias("b"))
    return best.select(key, F.col("b._p").alias("source_no"), *[F.col(f"b.{c}").alias(c) for c in cols if c != key])
