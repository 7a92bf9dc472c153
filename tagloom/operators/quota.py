"""Quotas: how many distinct records a tag has, what is missing, and which candidates fill it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATA = (("explicit", "e"), ("nsfw", "q"), ("sensitive", "s"), ("safe", "g"))


def quota_snapshot(rt: DataFrame, flag_tag: str) -> DataFrame:
    """(tag, stratum, flag, n) over rt (identity, tag), for all grouping sets of stratum and flag; null means any.

    The identity is a record's md5, or its path if it has none. A record in several folders counts once, with the
    strictest of its safety tags.
    """
    # Identities are dealt out once; their distinct tags, strata and flags are all found there.
    dealt = rt.where("identity is not null").select("identity", "tag").repartition("identity")
    safety = [tag for tag, _ in STRATA]
    level = F.lit(None).cast("int")
    for i, tag in enumerate(reversed(safety)):
        level = F.when(F.array_contains("tags", tag), i + 1).otherwise(level)
    codes = F.array(*[F.lit(c) for _, c in reversed(STRATA)])
    own = dealt.groupBy("identity").agg(F.collect_set(F.struct("tag")).alias("rows")).select(F.col("rows.tag").alias("tags"))
    own = own.select("tags", level.alias("_level"), F.coalesce(F.array_contains("tags", flag_tag), F.lit(False)).alias("flag"))
    df = own.select(F.explode("tags").alias("tag"), F.when(F.col("_level").isNotNull(), F.element_at(codes, F.col("_level"))).alias("stratum"), "flag")
    # One pass gives the finest counts; the coarser sets are sums of these few rows.
    finest = df.groupBy("tag", "stratum", "flag").agg(F.count("*").alias("n"))
    any_ = lambda kind: F.lit(None).cast(kind)
    sets = [("tag", any_("string"), any_("boolean"), F.lit(True)), ("tag", F.col("stratum"), any_("boolean"), F.col("stratum").isNotNull()), ("tag", any_("string"), F.lit(True), F.col("flag")), ("tag", F.col("stratum"), F.lit(True), F.col("flag") & F.col("stratum").isNotNull())]
    out = [F.when(test, F.struct(F.lit(i).alias("set"), F.col(tag).alias("tag"), s.alias("stratum"), f.alias("flag"))) for i, (tag, s, f, test) in enumerate(sets)]
    return finest.select("n", F.explode(F.array_compact(F.array(*out))).alias("k")).groupBy("k").agg(F.sum("n").alias("n")).select("k.tag", "k.stratum", "k.flag", "n")


def require_clean(rejects: DataFrame) -> None:
    """E7g: refuse to go on if any record could not be read."""
    if not rejects.isEmpty():
        raise ValueError("some records could not be read; counts would be too low")


def quota_gap(requests: DataFrame, counts: DataFrame, filled: DataFrame, keys: tuple[str, ...] = ("tag", "stratum")) -> DataFrame:
    """Requests with gap = max(0, target - current - filled)."""
    keys = list(keys)
    df = requests.join(counts.select(*keys, F.col("n").alias("_n")), keys, "left").join(filled.select(*keys, F.col("n").alias("_f")), keys, "left")
    return df.select(*requests.columns, F.greatest(F.lit(0), F.col("target") - F.coalesce("_n", F.lit(0)) - F.coalesce("_f", F.lit(0))).alias("gap"))


def dedupe_posts(posts: DataFrame) -> DataFrame:
    """One post per id, else per md5, else per whole row; the least row of each stays.

    An id of zero and empty texts count as missing.
    """
    missing = F.col("id").cast("string") == "" if posts.schema["id"].dataType.typeName() == "string" else F.col("id") == 0
    named = F.coalesce(F.when(~F.coalesce(missing, F.lit(True)), F.col("id").cast("string")), F.nullif("md5", F.lit("")))
    keyed = posts.where(named.isNotNull()).groupBy(named.alias("_k")).agg(F.min(F.struct(*posts.columns)).alias("_r")).select("_r.*")
    return keyed.unionAll(posts.where(named.isNull()).distinct())


def underfilled(candidates: DataFrame, counts: DataFrame, targets: dict[str, int] | None = None, absent_only: bool = False, total_target: int = 0, flag_target: int = 0) -> DataFrame:
    """(tag, current, missing map<stratum, target>, flag_target) of candidates (tag) for which anything is missing.

    counts (tag, stratum, flag, n) as of `quota_snapshot`; a tag that has none of a kind counts as 0. With targets by stratum,
    those strata are missing that have fewer; without them (missing is null) a tag is if it has fewer than total_target in
    all. flag_target is 0 where enough posts of the tag have the flag. Tags that need neither go, and with `absent_only` all
    that have any post at all.
    """
    n = lambda test: F.coalesce(F.max(F.when(test, F.col("n"))), F.lit(0))
    any_stratum, flagged = F.col("stratum").isNull(), F.coalesce("flag", F.lit(False))
    strata = F.collect_list(F.when(~any_stratum & ~flagged, F.struct("stratum", "n")))
    per = counts.groupBy("tag").agg(n(any_stratum & ~flagged).alias("_all"), n(any_stratum & flagged).alias("_flag"), F.map_from_entries(strata).alias("_n"))
    df = candidates.select("tag").distinct().join(per, "tag", "left").select("tag", F.coalesce("_all", F.lit(0)).alias("current"), F.coalesce("_flag", F.lit(0)).alias("_flag"), "_n")
    have = lambda k: F.coalesce(F.try_element_at(F.col("_n"), k), F.lit(0))
    if targets is None:
        missing, short = F.lit(None).cast("map<string,int>"), F.col("current") < total_target
    else:
        wanted = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])
        missing = F.map_filter(wanted, lambda k, v: have(k) < v)
        short = F.size(missing) > 0
    flag = F.when(F.col("_flag") < flag_target, flag_target).otherwise(0)
    out = df.where(short | (flag > 0)).select("tag", "current", missing.alias("missing"), flag.alias("flag_target"))
    return out.where("current = 0") if absent_only else out


def history_filter(candidates: DataFrame, versions: DataFrame, cutoff: Column) -> DataFrame:
    """Without candidates (tag_id) whose earliest version is before cutoff; no history keeps."""
    first = versions.groupBy("tag_id").agg(F.min("created_at").alias("_first"))
    return candidates.join(first, "tag_id", "left").where(F.col("_first").isNull() | (F.col("_first") >= cutoff)).select(*candidates.columns)


def oldest_post_filter(candidates: DataFrame, posts: DataFrame, cutoff: Column, today: Column) -> DataFrame:
    """Candidates (tag) whose oldest post lies in [cutoff, today]; none drops."""
    first = posts.groupBy("tag").agg(F.min("created_at").alias("_first"))
    return candidates.join(first, "tag").where(F.col("_first").between(cutoff, today)).select(*candidates.columns)


def exclude_variants(candidates: DataFrame, edges: DataFrame, categories: DataFrame) -> DataFrame:
    """Without candidates (tag) that an active edge (antecedent, consequent, status) leads to another character tag."""
    character = categories.where(F.col("category") == 4).select(F.col("tag").alias("consequent"))
    variants = edges.where((F.col("status") == "active") & (F.col("antecedent") != F.col("consequent"))).join(character, "consequent", "left_semi").select(F.col("antecedent").alias("tag")).distinct()
    return candidates.join(variants, "tag", "left_anti")


def expand_requests(candidates: DataFrame, sources: list[str], flag_target: int | None = None) -> DataFrame:
    """(source, tag, stratum, flag, target) per missing stratum and source, and one flag row per source."""
    src = F.explode(F.array(*map(F.lit, sources)))
    rows = candidates.select("tag", F.explode("missing").alias("stratum", "target")).select(src.alias("source"), "tag", "stratum", F.lit(False).alias("flag"), "target")
    if flag_target is None:
        return rows
    flags = candidates.select(src.alias("source"), "tag", F.lit(None).cast("string").alias("stratum"), F.lit(True).alias("flag"), F.lit(flag_target).alias("target"))
    return rows.unionAll(flags)


def request_identity(tags: Column) -> Column:
    """Words of a search in sorted order, so that their order doesn't matter."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(tags)), r"\s+"), lambda w: w != "")), " ")


def merge_requests(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(source, identity, target, owned, action) of both; new rows are inserted, owned rows refreshed, others kept.

    existing (source, tags, target, owned), new (source, tags, target).
    """
    old = existing.select("source", request_identity(F.col("tags")).alias("identity"), F.col("target").alias("_t"), F.col("owned").alias("_o")).groupBy("source", "identity").agg(F.max("_t").alias("_t"), F.min("_o").alias("_o"))
    add = new.select("source", request_identity(F.col("tags")).alias("identity"), "target").groupBy("source", "identity").agg(F.max("target").alias("target"))
    df = old.join(add, ["source", "identity"], "full_outer")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_o") & F.col("target").isNotNull(), "refresh").otherwise("keep")
    df = df.withColumn("action", action)
    return df.select("source", "identity", F.when(F.col("action") == "keep", F.col("_t")).otherwise(F.col("target")).alias("target"), F.coalesce("_o", F.lit(True)).alias("owned"), "action")


def pending_requests(rows: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unfinished rows (source, query, target, status) that are valid, and the others with a reason."""
    from tagloom.operators.gate import parse_query

    df = parse_query(rows.where(F.col("status") != "finished"))
    reason = F.when(~F.coalesce(F.col("source").isin(sources), F.lit(False)), "source").when(~F.coalesce(F.col("target") >= 1, F.lit(False)), "target").when(~F.col("valid"), "query")
    df = df.withColumn("reason", reason)
    return df.where("reason is null").drop("reason", "valid"), df.where("reason is not null").select("source", "query", "target", "reason")


def requests_for_tags(tags: DataFrame, defaults: dict[str, int], strata: dict[str, int] | None = None) -> DataFrame:
    """Request rows of hand-picked tags; names with spaces, wildcards or a leading minus go."""
    name = F.lower(F.trim("tag"))
    good = tags.select(name.alias("tag")).where((F.col("tag") != "") & ~F.col("tag").rlike(r"[\s*?]|^-")).distinct()
    if strata:
        wanted = F.create_map(*[x for k, v in strata.items() for x in (F.lit(k), F.lit(v))])
        return expand_requests(good.withColumn("missing", wanted), list(defaults))
    rows = F.explode(F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])).alias("source", "target")
    return good.select("tag", rows).select("source", "tag", F.lit(None).cast("string").alias("stratum"), F.lit(False).alias("flag"), "target")


def outcome_counts(df: DataFrame, col: str = "outcome") -> DataFrame:
    """(outcome, n), most first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def progress_report(log: DataFrame, total: int) -> DataFrame:
    """One row over a log (outcome, seconds): processed, percent, average, remaining, skipped, truncated."""
    df = log.agg(F.count_if(F.col("outcome") == "processed").alias("processed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "truncated").alias("truncated"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("elapsed"))
    average = F.when(F.col("processed") > 0, F.col("elapsed") / F.col("processed")).otherwise(0.0)
    return df.select("processed", "skipped", "truncated", F.round(F.lit(100.0) * F.col("processed") / max(1, total), 0).alias("percent") if total else F.lit(100.0).alias("percent"), F.round(average, 3).alias("average"), F.round(average * F.greatest(F.lit(0), F.lit(total) - F.col("processed")), 1).alias("remaining"))


def order_pending(records: DataFrame, captions: DataFrame) -> DataFrame:
    """Records, those with a looked-up caption first, then by lower-case name."""
    have = captions.select("record_id").distinct().withColumn("has_caption", F.lit(True))
    df = records.join(have, "record_id", "left").withColumn("has_caption", F.coalesce("has_caption", F.lit(False)))
    return df.orderBy(~F.col("has_caption"), F.lower("name"))
