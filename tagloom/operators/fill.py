"""Filling quotas: which posts are taken for which requests, when a post counts for every request that it satisfies.

Requests are served in order. A request takes the first posts of its source that pass its filters, until its gap is closed;
a post that an earlier request took is not taken again (equal md5, whatever the source), and counts for every later request
whose tag, stratum and flag it has, so that less is missing there. What a request takes thus depends on all earlier ones.

Spark does this in rounds of proposing and accepting. In each, every request proposes the first posts that the earlier requests
didn't propose in the last round, up to its gap less their credits. After k rounds the first k requests have their final
picks, and all others whose earlier ones in reach have them; when a round changes nothing, each request's picks follow
from those of all earlier ones by the rule above, which only the sequential result does. So the end is that result, after as
many rounds as the longest chain of requests that change each other.

Few candidates can ever be taken. One that is the only post with its md5 is credited to the request when an earlier one
takes it, so the picks lie among those with fewer such posts before them than the gap has places. Candidates are cut to these
by counts for each level of score first, for which no candidate is shuffled, then in parts of a request, in ever fewer parts, so
that no task ranks all candidates of a common tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.gate import MD5
from tagloom.sources.shared import checkpoint

#: Parts of a request's candidates that are ranked and cut one after the other.
PARTS = (64, 8)
FLAG_TAG = "official art"


def candidate_posts(posts: DataFrame, existing: DataFrame | None = None, flag_tag: str = FLAG_TAG) -> DataFrame:
    """Posts (source, id, md5, rating, score, tags) once each, with a valid md5 that existing (md5) lacks.

    Adds `flag`, whether it has the flag tag, and `alone`, whether no other post has its md5. A post given twice counts as
    one, by the smallest of its rows.
    """
    rows = posts.select("source", "id", F.lower("md5").alias("md5"), "rating", F.col("score").cast("double").alias("score"), F.array_distinct("tags").alias("tags"))
    rows = rows.where(F.coalesce(F.col("md5").rlike(MD5), F.lit(False)))
    rows = rows.groupBy("source", "id", "md5").agg(F.min(F.struct("rating", "score", "tags")).alias("r")).select("source", "id", "md5", "r.*")
    if existing is not None:
        rows = rows.join(existing.select(F.lower("md5").alias("md5")).distinct(), "md5", "left_anti")
    flag = F.coalesce(F.array_contains("tags", flag_tag), F.lit(False))
    alone = F.count("*").over(Window.partitionBy("md5")) == 1
    return rows.select("source", "id", "md5", "rating", "score", "tags", flag.alias("flag"), alone.alias("alone"))


def level() -> Column:
    """A scale that keeps the order of scores, with some hundred levels for each tenfold; null is the lowest."""
    return F.coalesce(F.signum("score") * F.rint(F.log1p(F.abs("score")) * 256), F.lit(float("-inf")))


def lowest_levels(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, gap, _cut): the highest level before which a request has as many posts alone with their md5 as its gap has places.

    _cut is null if there is none.
    """
    counts = edges.groupBy("seq", level().alias("_level")).agg(F.sum(F.col("alone").cast("int")).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("seq").orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_above", F.coalesce(above, F.lit(0))).join(requests.select("seq", "gap"), "seq")
    return counts.groupBy("seq", "gap").agg(F.max(F.when(F.col("_above") >= F.col("gap"), F.col("_level"))).alias("_cut"))


def candidate_edges(requests: DataFrame, posts: DataFrame) -> DataFrame:
    """(seq, gap, place, md5, source, id, score, alone, matches): a request's candidates by falling score, then id.

    matches has the numbers of all requests whose tag, stratum and flag the post has, whatever their source and scores.
    """
    r = requests.select("seq", F.col("source").alias("_source"), "tag", "stratum", F.coalesce("flag", F.lit(False)).alias("_flag"), "min_score", F.coalesce("gap", F.lit(0)).alias("gap"))
    p = posts.select("source", "id", "md5", "rating", "score", "flag", "alone", F.explode("tags").alias("tag"))
    fits = (F.col("stratum").isNull() | (F.col("stratum") == F.col("rating"))) & (~F.col("_flag") | F.col("flag"))
    offered = (F.col("source") == F.col("_source")) & (F.col("gap") > 0) & (F.col("min_score").isNull() | (F.col("score") >= F.col("min_score")))
    hit = F.struct("seq", F.coalesce(offered, F.lit(False)).alias("offered"))
    met = p.join(r, "tag").where(F.coalesce(fits, F.lit(False))).groupBy("source", "id", "md5", "score", "alone").agg(F.collect_list(hit).alias("hits"))
    # A post that is offered to no request is never taken, so it is credited to none.
    met = checkpoint(met.where(F.exists("hits", lambda h: h["offered"])))
    edges = met.select(F.explode(F.filter("hits", lambda h: h["offered"])["seq"]).alias("seq"), "source", "id", "md5", "score", "alone", F.col("hits.seq").alias("matches"))
    # One row for a request.
    edges = edges.join(F.broadcast(lowest_levels(edges, r)), "seq").where(F.col("_cut").isNull() | (level() > F.col("_cut"))).drop("_cut")
    order = (F.col("score").desc_nulls_last(), F.col("id"), F.col("md5"))
    parts = [Window.partitionBy("seq", F.pmod(F.xxhash64("md5", "id"), F.lit(n))) for n in PARTS]
    for w in (*parts, Window.partitionBy("seq")):
        before = F.sum(F.col("alone").cast("int")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        edges = edges.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < F.col("gap")).drop("_before")
    # Of a request's posts with one md5 only the first can be taken.
    edges = edges.withColumn("place", F.row_number().over(Window.partitionBy("seq").orderBy(*order)))
    return edges.withColumn("_first", F.min("place").over(Window.partitionBy("seq", "md5"))).where("place = _first").drop("_first")


def propose(edges: DataFrame, picks: DataFrame | None) -> DataFrame:
    """(seq, place, md5, matches, rank): what each request takes after the picks of earlier ones."""
    need = F.col("gap")
    if picks is not None:
        taken = picks.groupBy("md5").agg(F.min(F.struct("seq", "matches")).alias("_t"))
        credit = taken.select(F.explode(F.filter("_t.matches", lambda s: s > F.col("_t.seq"))).alias("seq")).groupBy("seq").agg(F.count("*").alias("_credit"))
        edges = edges.join(taken.select("md5", F.col("_t.seq").alias("_by")), "md5", "left").where(F.col("_by").isNull() | (F.col("_by") >= F.col("seq")))
        edges = edges.join(credit, "seq", "left")
        need = need - F.coalesce("_credit", F.lit(0))
    ranked = edges.withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy("place")))
    return ranked.where(F.col("rank") <= need).select("seq", "place", "md5", "matches", "rank")


def fill_requests(requests: DataFrame, posts: DataFrame, existing: DataFrame | None = None, flag_tag: str = FLAG_TAG) -> DataFrame:
    """(seq, source, id, md5, score, rank): the posts that are taken for each request, in the order of taking.

    requests (seq, source, tag, stratum, flag, min_score, gap) have distinct seq; a null stratum, flag or min_score asks for
    nothing, a null gap for no post. posts (source, id, md5, rating, score, tags array) are eligible ones, with ratings and tags
    in the requests' spelling; those without a valid md5 or with one of existing (md5) are neither taken nor counted. Null
    scores come last and pass no minimum. Repeated posts count once; empty tables give no rows.
    """
    edges = checkpoint(candidate_edges(requests, candidate_posts(posts, existing, flag_tag)))
    picks = checkpoint(propose(edges, None))
    before = None
    # Picks are told apart by their number and two sums of hashes, which takes no shuffle.
    same = (F.count("*"), F.sum(F.xxhash64("seq", "md5").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("md5", "seq")))
    while (now := tuple(picks.agg(*same).first())) != before:
        before, picks = now, checkpoint(propose(edges, picks))
    return edges.join(picks.select("seq", "place", "rank"), ["seq", "place"]).select("seq", "source", "id", "md5", "score", "rank")
