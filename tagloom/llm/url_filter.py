"""Operator 9: URL verdicts from rules and from trust that spreads over the links between hosts.

Rules are host suffixes with a path prefix; the longest that fits an URL decides, equal ones by their text. Hosts whose
pages rules allow or block are the seeds. Trust is a personalised PageRank along the links between hosts from the
allowed seeds, distrust one against the links from the blocked seeds; both run as Spark joins for a fixed number of
rounds. Relative to its share of pages, a host whose distrust reaches `threshold` and exceeds its trust is blocked;
every other page without a rule is allowed.

Links are those in the pages' html that name a host, with a scheme or without one (`//host/path`). With `tree` a host and the
host without its first label are joined both ways as well, with that weight for each pair; by default links alone count, as
edges of the tree are none. link_trust and link_distrust are the ranks by the links alone.

A null URL or one without `://` has empty host and path, no rule, and is allowed. Null html has no links. Repeated rows give
repeated results (and count as pages of their host), an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import checkpoint, shuffle_partitions

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROUNDS = 10
DAMPING = 0.85
THRESHOLD = 0.2
TREE = 0.0
LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#"'\s>]++)"""


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host and path of url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    hits = [
        F.when(((host == r) | F.endswith(host, F.lit(f".{r}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(r + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, r, p in ordered
    ]
    return F.coalesce(*hits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(parsed: DataFrame, tree: float = TREE) -> DataFrame:
    """(src, dst, link, weight): edges between hosts, with the number of links, and with that and the tree's weight.

    parsed has host and links, an array of hosts.
    """
    links = parsed.where(F.col("host") != "").select("host", F.explode("links").alias("dst"))
    links = links.where("host <> dst").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("link")).withColumn("weight", F.col("link"))
    if not tree:
        return links
    hosts = parsed.where(F.col("host") != "").select("host").distinct()
    labels = F.split("host", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".").alias("a"), F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".").alias("b")))
    pairs = hosts.where(F.size(labels) > 2).select(F.explode(steps).alias("s")).select("s.a", "s.b").distinct()
    weights = (F.lit(0.0).alias("link"), F.lit(float(tree)).alias("weight"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), *weights).unionAll(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), *weights))
    return links.unionAll(both).groupBy("src", "dst").agg(F.sum("link").alias("link"), F.sum("weight").alias("weight"))


def host_scores(parsed: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tree: float = TREE) -> DataFrame:
    """(host, pages, trust, distrust, link_trust, link_distrust), ranks per page.

    A rank of 1 is that of a host whose every page is a seed and that has no edge. parsed has host, links and verdict (null
    where no rule fits).
    """
    edges = checkpoint(host_edges(parsed, tree))
    counts = parsed.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    ends = edges.select(F.col("src").alias("host")).unionAll(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = checkpoint(ends.join(counts, "host", "full_outer").select("host", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("pages", "good", "bad")]))
    # Every host also keeps a part of its rank, so no rank leaks away where a host has no edge.
    one = F.lit(1.0)
    out = edges.unionAll(hosts.select(F.col("host").alias("src"), F.col("host").alias("dst"), one.alias("link"), one.alias("weight")))
    # forward: share of src's weight that goes to dst; backward: share of dst's incoming weight that comes from src.
    total = lambda key: out.groupBy(F.col(key).alias("_k")).agg(F.sum("link").alias("_l"), F.sum("weight").alias("_w"))
    share = (F.col("link") / F.col("_l"), F.col("weight") / F.col("_w"))
    none = F.lit(0.0)
    ahead = out.join(total("src"), out["src"] == F.col("_k")).select(F.col("src").alias("u"), F.col("dst").alias("v"), share[0].alias("lf"), share[1].alias("f"), none.alias("lb"), none.alias("b"))
    back = out.join(total("dst"), out["dst"] == F.col("_k")).select(F.col("dst").alias("u"), F.col("src").alias("v"), none.alias("lf"), none.alias("f"), share[0].alias("lb"), share[1].alias("b"))
    steps = checkpoint(ahead.unionAll(back).groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in ("lf", "f", "lb", "b")]))
    ranks = {"trust": ("good", "f"), "distrust": ("bad", "b"), "link_trust": ("good", "lf"), "link_distrust": ("bad", "lb")}
    rank = hosts.select("host", *[F.col(seed).alias(r) for r, (seed, _) in ranks.items()])
    for k in range(rounds):
        moved = steps.join(rank, F.col("u") == F.col("host")).groupBy("v").agg(*[F.sum(F.col(r) * F.col(by)).alias(r) for r, (_, by) in ranks.items()])
        rank = hosts.select("host", "good", "bad").join(moved, F.col("host") == F.col("v")).select("host", *[((1 - damping) * F.col(seed) + damping * F.col(r)).alias(r) for r, (seed, _) in ranks.items()])
        if k % 5 == 4:
            rank = checkpoint(rank)
    per = F.greatest(F.col("pages"), one)
    return rank.join(hosts.select("host", "pages"), "host").select("host", "pages", *[(F.col(r) / per).alias(r) for r in ranks])


def with_scores(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """pages (page_id, host, path, ...) with the scores of their hosts.

    A host with more than an even share of a partition's pages has its pages and a copy of its row for each of them dealt to all
    partitions. There are at most as many such hosts as partitions, so their list is broadcast with that bound.
    """
    n = shuffle_partitions(pages.sparkSession)
    total = scores.agg(F.sum("pages").alias("_all"))
    hot = F.col("pages") * n > F.col("_all")
    known = checkpoint(scores.crossJoin(F.broadcast(total)).withColumn("_hot", hot).drop("_all", "pages"))
    copies = known.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    names = F.broadcast(known.where("_hot").select("host", "_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("page_id", "path"), F.lit(n)).cast("int")).otherwise(0)
    return pages.join(names, "host", "left").withColumn("_salt", salt).drop("_hot").join(copies, ["host", "_salt"], "left").drop("_salt")


def url_verdicts(pages: DataFrame, rules: tuple = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD, tree: float = TREE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's ranks, for every row of pages (page_id, url, html)."""
    parsed = with_parts(pages.select("page_id", "url", "html")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    links = F.transform(F.coalesce(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.array().cast("array<string>")), lambda h: F.translate(h, UPPER, LOWER))
    # The html is read once.
    parsed = checkpoint(parsed.select("page_id", "host", "path", "_r.rule", "_r.verdict", links.alias("links")))
    scored = with_scores(parsed.drop("links"), host_scores(parsed, rounds, damping, tree))
    spread = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", spread).alias("verdict"), "trust", "distrust", "link_trust", "link_distrust")
