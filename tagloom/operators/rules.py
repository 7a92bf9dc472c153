"""Tag rules over record_tags (record_id, pos, tag): replacement, ignoring, conditional removal, dropout, order.

Rule tables are DataFrames. Lists are rebuilt by position, so order survives the shuffle; of a record's tags only those that
rules name meet, in one aggregation on record_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tagloom.functions.norm import normalize_tag, parse_tags
from tagloom.operators.literals import small_rows


def explode_tags(records: DataFrame, col: str) -> DataFrame:
    """(record_id, pos, tag) of the parsed comma tags of a column."""
    return records.select("record_id", F.posexplode(parse_tags(F.col(col))).alias("pos", "tag"))


def collect_tags(rt: DataFrame, name: str = "tags") -> DataFrame:
    """(record_id, tags) in the order of pos."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "tag")))
    return rt.groupBy("record_id").agg(ordered.alias("rows")).select("record_id", F.col("rows.tag").alias(name))


def first_occurrences(rt: DataFrame) -> DataFrame:
    """The first position of each tag of a record."""
    return rt.groupBy("record_id", "tag").agg(F.min("pos").alias("pos")).select("record_id", "pos", "tag")


def _replacements(mapping: DataFrame) -> DataFrame:
    """(_old, _new) in clean form; the smallest new of each old."""
    return mapping.select(normalize_tag(F.col("old")).alias("_old"), normalize_tag(F.col("new")).alias("_new")).where("_old <> '' and _new <> ''").groupBy("_old").agg(F.min("_new").alias("_new"))


def replace_tags(rt: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags replaced through mapping (old, new), both normalised; if old repeats, its smallest new counts."""
    m = _replacements(mapping)
    return rt.join(m, rt["tag"] == F.col("_old"), "left").select(*[F.coalesce("_new", "tag").alias("tag") if c == "tag" else c for c in rt.columns])


def tags_with_fragment(tags: DataFrame, fragments: DataFrame) -> DataFrame:
    """The distinct tags (tag) that contain a fragment (fragment).

    Every distinct tag is cut into its parts of the lengths that fragments have, and these are joined; a null or empty fragment is in
    none. So the fragments can be as many as there are.
    """
    some = fragments.where(F.length("fragment") > 0).select("fragment").distinct()
    lengths = some.agg(F.collect_set(F.length("fragment")).alias("_lengths"))  # one row: no more numbers than the longest fragment has characters
    cut = lambda n: F.when(F.length("tag") >= n, F.transform(F.sequence(F.lit(1), F.length("tag") - n + 1), lambda i: F.substring("tag", i, n))).otherwise(F.array().cast("array<string>"))
    parts = tags.select("tag").where("tag is not null").distinct().crossJoin(F.broadcast(lengths)).select("tag", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", cut)))).alias("fragment"))
    return parts.join(some, "fragment", "left_semi").select("tag").distinct()


def _has_any(tag: Column, fragments: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, fragments)), lambda f: F.contains(tag, f)) if fragments else F.lit(False)


def drop_ignored(rt: DataFrame, exact: DataFrame, fragments: DataFrame, small: int | None = None) -> DataFrame:
    """Without tags of exact (tag), and without tags that contain a fragment (fragment); a null tag stays."""
    df = rt.join(exact.select("tag"), "tag", "left_anti")
    few = small_rows(fragments.where(F.length("fragment") > 0).select("fragment"), small)
    if few is None:
        return df.join(tags_with_fragment(rt, fragments), "tag", "left_anti").select(*rt.columns)
    return df.where(F.coalesce(~_has_any(F.col("tag"), [r.fragment for r in few]), F.lit(True))).select(*rt.columns)


def expand_rules(pairs: DataFrame, mains: DataFrame, combos: DataFrame, both: DataFrame, colors: DataFrame) -> DataFrame:
    """(remove, present) rules from templates.

    pairs (remove, present) as they are; mains (main): `color main` removes main; combos (remove, present): `color
    remove` goes if present is there; both (remove, present): colours on both sides. The colour list is a small rule table.
    """
    c = F.col
    color = colors.select("color")
    a = pairs.select("remove", "present")
    b = mains.crossJoin(color).select(c("main").alias("remove"), F.concat_ws(" ", "color", "main").alias("present"))
    d = combos.crossJoin(color).select(F.concat_ws(" ", "color", "remove").alias("remove"), "present")
    two = color.select(c("color").alias("color2"))
    e = both.crossJoin(color).crossJoin(two).select(F.concat_ws(" ", "color", "remove").alias("remove"), F.concat_ws(" ", "color2", "present").alias("present"))
    return a.unionAll(b).unionAll(d).unionAll(e).distinct()


def _by_removed(rules: DataFrame) -> DataFrame:
    """(_remove, _present): the tags of a record that remove a tag."""
    return rules.groupBy(F.col("remove").alias("_remove")).agg(F.collect_set("present").alias("_present"))


def fired_rules(rt: DataFrame, rules: DataFrame, small: int | None = None) -> DataFrame:
    """(record_id, remove, present): rules whose two tags a record has, each once.

    Only tags that a rule names are gathered, by record, without the other columns.
    """
    named = rules.select(F.explode(F.array("remove", "present")).alias("tag")).where("tag is not null").distinct()
    few = small_rows(named, small)
    # By tag all records would meet in as few tasks as there are tags, so few names are a filter.
    own = rt.select("record_id", "tag")
    own = own.join(named, "tag", "left_semi") if few is None else own.where(F.col("tag").isin([r.tag for r in few]))
    own = own.groupBy("record_id").agg(F.collect_set("tag").alias("tags"))
    met = own.select("record_id", "tags", F.explode("tags").alias("_remove")).join(_by_removed(rules), "_remove")
    return met.select("record_id", F.col("_remove").alias("remove"), F.explode(F.array_intersect("_present", "tags")).alias("present"))


def apply_rules(rt: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: rt without the tags that fired rules remove, and those rules; one pass on the tags as they came.

    What is removed is held against the tags by record and tag, by broadcast where the planner finds it little. Rows without an
    id are one record.
    """
    fired = fired_rules(rt, rules)
    gone = fired.select(F.col("record_id").alias("_id"), F.col("remove").alias("_tag")).distinct()
    return rt.join(gone, F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left_anti"), fired


def clean_in_row(tags: Column, mapping: dict[str, str], exact: list[str], fragments: list[str]) -> Column:
    """C1 and C2 on an array of parsed tags, then first occurrences."""
    if mapping:
        table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
        tags = F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t))
    if exact:
        tags = F.filter(tags, lambda t: ~t.isin(exact))
    if fragments:
        tags = F.filter(tags, lambda t: ~_has_any(t, fragments))
    return F.array_distinct(tags)


def apply_in_row(df: DataFrame, col: str, rules: dict[str, list[str]]) -> DataFrame:
    """C4 on an array column of distinct tags: those go that a rule removes, by the tags as they came. rules: tag to the tags that remove it."""
    if not rules:
        return df
    table = F.create_map(*[x for tag, present in sorted(rules.items()) for x in (F.lit(tag), F.array(*map(F.lit, sorted(present))))])
    kept = F.filter(col, lambda t: ~F.coalesce(F.arrays_overlap(F.try_element_at(table, t), F.col(col)), F.lit(False)))
    return df.withColumn(col, kept)


def clean_tags(records: DataFrame, col: str, mapping: DataFrame, exact: DataFrame, fragments: DataFrame, rules: DataFrame, small: int | None = None) -> DataFrame:
    """(record_id, tags): parse, replace, ignore, first occurrences, conditional removal; empty lists stay.

    With rule tables of some hundred rows all of it runs in the row, without a shuffle; larger ones are joined. A null text has no
    tags, null rules are left out, repeated records give repeated rows in the row and one row by joins.
    """
    tables = [
        small_rows(t, small)
        for t in (_replacements(mapping), exact.where("tag is not null").select("tag"), fragments.where(F.length("fragment") > 0).select("fragment"), rules.where("remove is not null and present is not null").select("remove", "present"))
    ]
    if any(t is None for t in tables):
        return _clean_by_joins(records, col, mapping, exact, fragments, rules)
    old, whole, parts, pairs = tables
    present: dict[str, list[str]] = {}
    for r in pairs:
        present.setdefault(r.remove, []).append(r.present)
    df = records.select("record_id", clean_in_row(parse_tags(F.col(col)), {r[0]: r[1] for r in old}, [r[0] for r in whole], [r[0] for r in parts]).alias("tags"))
    return apply_in_row(df, "tags", present)


def _clean_by_joins(records: DataFrame, col: str, mapping: DataFrame, exact: DataFrame, fragments: DataFrame, rules: DataFrame) -> DataFrame:
    """C6 for rule tables of any size.

    Ignored tags become null rather than go, so that a record without any tag left is still there.
    """
    rt = records.select("record_id", F.posexplode_outer(parse_tags(F.col(col))).alias("pos", "tag"))
    rt = replace_tags(rt, mapping).join(exact.select(F.col("tag").alias("_exact")).distinct(), F.col("tag") == F.col("_exact"), "left")
    rt = rt.join(tags_with_fragment(rt, fragments).select("tag", F.lit(True).alias("_part")), "tag", "left")
    rt = rt.select("record_id", "pos", F.when(F.col("_exact").isNull() & F.col("_part").isNull(), F.col("tag")).alias("tag"))
    rt = rt.join(_by_removed(rules), F.col("tag") == F.col("_remove"), "left")
    row = F.when(F.col("tag").isNotNull(), F.struct("pos", "tag", "_present"))
    own = rt.groupBy("record_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    own = own.select("record_id", "rows", F.transform("rows", lambda r: r["tag"]).alias("tags"))
    kept = F.filter("rows", lambda r: ~F.coalesce(F.arrays_overlap(r["_present"], "tags"), F.lit(False)))
    return own.select("record_id", F.array_distinct(F.transform(kept, lambda r: r["tag"])).alias("tags"))


def _draw(tag: Column, seed: int) -> Column:
    """A number in [0, 1) from record, tag and seed, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col("record_id").cast("string"), tag, F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0


def tag_dropout(rt: DataFrame, rate: float, min_tags: int, protected: list[str], seed: int) -> DataFrame:
    """Rt without dropped tags; if fewer than min_tags stay, the first dropped ones come back."""
    if rate <= 0:
        return rt
    keep = F.col("tag").isin(protected) | ((_draw(F.col("tag"), seed) >= rate) & F.lit(rate < 1))
    w = Window.partitionBy("record_id")
    df = rt.withColumn("_keep", keep).withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(w))
    df = df.withColumn("_rank", F.row_number().over(Window.partitionBy("record_id", "_keep").orderBy("pos")))
    return df.where(F.col("_keep") | (F.col("_rank") <= F.lit(min_tags) - F.col("_kept"))).select(*rt.columns)


def keep_allowed(rt: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only tags of allowed (tag), compared without case."""
    return rt.join(allowed.select(F.lower("tag").alias("_a")).distinct(), F.lower(rt["tag"]) == F.col("_a"), "left_semi")


def split_by_membership(tags: Column, members: list[str]) -> tuple[Column, Column]:
    """The tags in members and the others, order kept, compared without case."""
    inside = lambda t: F.lower(t).isin(members)
    return F.filter(tags, inside), F.filter(tags, lambda t: ~inside(t))


def shuffle_section(tags: Column, record_id: Column, seed: int) -> Column:
    """Tags in an order that record, tag and seed fix."""
    key = lambda t: F.md5(F.concat_ws("|", record_id.cast("string"), t, F.lit(str(seed))))
    return F.transform(F.array_sort(F.transform(tags, lambda t: F.struct(key(t).alias("k"), t.alias("t")))), lambda x: x["t"])


def required_terms(rt: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(record_id, terms): first occurrences of tags found in vocabulary (term), in tag order."""
    found = rt.withColumn("tag", normalize_tag(F.col("tag"), "terms")).join(vocabulary.select(F.col("term").alias("tag")).distinct(), "tag", "left_semi")
    return collect_tags(first_occurrences(found), "terms")


def combination_rules(rt: DataFrame, rules: DataFrame, small: int | None = None) -> DataFrame:
    """(record_id, rule, note) of rules (rule, all_of, none_of, note) whose tags are all there and none is barred.

    With some hundred rules of different names, the tags that they name are gathered by record once and all rules are tried in
    the row; more are joined by tag. Null rules and rules without all_of never hold.
    """
    few = small_rows(rules.where("rule is not null"), small)
    if few is None or len({r.rule for r in few}) < len(few):
        return _combinations_by_joins(rt, rules)
    few = [r for r in few if r.all_of and None not in r.all_of]
    if not few:
        return rt.select("record_id").limit(0).crossJoin(rules.select("rule", "note").limit(0))
    named = sorted({t for r in few for t in [*r.all_of, *(r.none_of or [])] if t is not None})
    own = rt.where(F.col("tag").isin(named)).groupBy("record_id").agg(F.collect_set("tag").alias("tags"))
    kinds = dict(rules.dtypes)
    note = lambda r: F.lit(r.note).cast(kinds["note"])

    def holds(r: Row) -> Column:
        barred = sorted({t for t in r.none_of or [] if t is not None})
        test = F.size(F.array_except(F.array(*map(F.lit, sorted(set(r.all_of)))), F.col("tags"))) == 0
        return test & ~F.arrays_overlap(F.array(*map(F.lit, barred)), F.col("tags")) if barred else test

    met = [F.when(holds(r), F.struct(F.lit(r.rule).cast(kinds["rule"]).alias("rule"), note(r).alias("note"))) for r in sorted(few, key=lambda r: str(r.rule))]
    return own.select("record_id", F.inline(F.array_compact(F.array(*met)))).select("record_id", "rule", "note")


def _combinations_by_joins(rt: DataFrame, rules: DataFrame) -> DataFrame:
    """C26 for rules of any number."""
    own = rt.select("record_id", "tag").distinct()
    need = rules.select("rule", F.size("all_of").alias("_n"), F.explode("all_of").alias("tag"))
    met = own.join(need, "tag").groupBy("record_id", "rule", "_n").agg(F.count("*").alias("_got")).where("_got = _n").select("record_id", "rule")
    barred = own.join(rules.select("rule", F.explode("none_of").alias("tag")), "tag").select("record_id", "rule").distinct()
    return met.join(barred, ["record_id", "rule"], "left_anti").join(rules.select("rule", "note"), "rule").select("record_id", "rule", "note")
