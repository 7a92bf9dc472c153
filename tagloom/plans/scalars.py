"""Queries of the column functions: one input, many expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import norm
from tagloom.plans.fixtures import sql
from tagloom.plans.registry import register

#: Strings with escapes, underscores, blanks, repeats and commas from each part.
PARTS = """SELECT p_partkey AS id, concat('  _', p_brand, ' ', chr(92), '(', p_type, chr(92), ')__', p_name, '_ ') AS raw,
  concat(p_name, ', ,', p_brand, ',  ', upper(p_name), ',,', p_type, '_(x), ', replace(p_name, ' ', '_')) AS tags,
  CASE WHEN p_partkey % 3 = 0 THEN concat(replace(p_name, ' ', '_'), ' ', p_type) WHEN p_partkey % 3 = 1 THEN p_name ELSE concat(p_name, ', ', p_type) END AS meta,
  concat(replace(p_name, ' ', '_'), '_(', lower(p_type), ')  ', p_brand) AS source
FROM {part}"""
ORDERS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN ' inf ' WHEN o_orderkey % 17 = 0 THEN '3.9' WHEN o_orderkey % 19 = 0 THEN '-1.5' ELSE concat(cast(cast(round(o_totalprice / 1500 - 20) AS int) AS {string}), '.7') END AS score,
  CASE o_orderkey % 9 WHEN 0 THEN 'G' WHEN 1 THEN ' general ' WHEN 2 THEN 's' WHEN 3 THEN 'sensitive' WHEN 4 THEN 'q' WHEN 5 THEN 'questionable' WHEN 6 THEN 'Explicit' WHEN 7 THEN 'safe' ELSE '?' END AS rating,
  CASE o_orderkey % 5 WHEN 0 THEN concat(cast(2009 + 2 * (year(o_orderdate) - 1995) AS {string}), '-01-01T00:30:00+05:00') WHEN 1 THEN concat(cast(2010 + year(o_orderdate) - 1995 AS {string}), '-12-31')
    WHEN 2 THEN concat('Sat Mar 07 12:00:01 +0100 ', cast(year(o_orderdate) + 20 AS {string})) WHEN 3 THEN '' ELSE concat(cast(year(o_orderdate) AS {string}), '-06-01T10:00:00Z') END AS created
FROM {orders}"""

_unescape = lambda x: f"replace(replace({x}, chr(92) || '(', '('), chr(92) || ')', ')')"
_spaced = lambda x: f"replace({x}, '_', ' ')"
_fold = lambda x: rf"regexp_replace({x}, '\s+', ' ', 'g')"
_strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
clean = lambda x: f"lower(trim({_fold(_spaced(_unescape(x)))}))"
output = lambda x: f"trim({_fold(_spaced(x))})"
stats = lambda x: _fold(_spaced(_unescape(f"lower({_strip(x)})")))
character = lambda x: f"trim({_fold(_spaced(f'lower({x})'))})"
_list = lambda x, f: f"list_filter(list_transform(string_split({x}, ','), lambda t: {f('t')}), lambda t: t <> '')"
_first = lambda x: f"list_transform(list_filter(list_transform({x}, lambda t, i: {{'t': t, 'p': list_position({x}, t) = i}}), lambda s: s.p), lambda s: s.t)"


def _whole() -> str:
    return "trunc(CASE WHEN isfinite(try_cast(trim(score) AS DOUBLE)) THEN try_cast(trim(score) AS DOUBLE) END)"


def _limits(i: int) -> str:
    return f"CASE WHEN lower(trim(rating)) IN ('g', 'general', 'safe', 's', 'sensitive') THEN {norm.SAFE_LIMITS[i]} ELSE {norm.OTHER_LIMITS[i]} END"


QUALITY = "CASE WHEN " + _whole() + " IS NULL THEN '' " + " ".join(f"WHEN {_whole()} > {_limits(i)} THEN '{norm.QUALITY_LABELS[i]}'" for i in range(5)) + " ELSE 'worst quality' END"
_ISO = r"'^\s*(\d{4})-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*$', 1)"
_YEAR = f"try_cast(regexp_extract(created, {_ISO} AS INT)"
PERIOD = f"CASE WHEN {_YEAR} IS NULL THEN '' WHEN {_YEAR} >= 2021 THEN 'newest' WHEN {_YEAR} >= 2018 THEN 'recent' WHEN {_YEAR} >= 2015 THEN 'mid' WHEN {_YEAR} >= 2011 THEN 'early' ELSE 'old' END"
_LONG = r"regexp_extract(created, '^\s*[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} (\d{4})\s*$', 1)"
YEAR = f"CASE WHEN regexp_extract(created, {_ISO} || {_LONG} <> '' THEN 'year ' || regexp_extract(created, {_ISO} || {_LONG} ELSE '' END"
SAFETY = "CASE lower(trim(rating)) WHEN 'e' THEN ['explicit', 'nsfw'] WHEN 'explicit' THEN ['explicit', 'nsfw'] WHEN 'q' THEN ['nsfw'] WHEN 'questionable' THEN ['nsfw'] WHEN 's' THEN ['sensitive'] WHEN 'sensitive' THEN ['sensitive'] WHEN 'g' THEN ['safe'] WHEN 'general' THEN ['safe'] ELSE [] END"
RATING = "CASE WHEN lower(trim(rating)) IN ('g', 'general') THEN 'g' WHEN lower(trim(rating)) IN ('s', 'safe', 'sensitive') THEN 's' WHEN lower(trim(rating)) IN ('q', 'questionable') THEN 'q' WHEN lower(trim(rating)) IN ('e', 'explicit') THEN 'e' ELSE '' END"
ISO_CREATED = r"CASE WHEN created LIKE '% +%' THEN regexp_replace(created, '^... ... (..) (........) (...)(..) (....)$', '\5-03-\1T\2\3:\4') ELSE created END"

c = F.col
SCALARS: list[tuple[str, str, dict[str, tuple[Callable[[], Column], str]]]] = [
    ("b1_normalize_tag", PARTS, {
        "clean": (lambda: norm.normalize_tag(c("raw"), "clean"), clean("raw")),
        "output": (lambda: norm.normalize_tag(c("raw"), "output"), output("raw")),
        "stats": (lambda: norm.normalize_tag(c("raw"), "stats"), stats("raw")),
        "cache": (lambda: norm.normalize_tag(c("raw"), "cache"), stats("raw")),
        "prompt": (lambda: norm.normalize_tag(c("raw"), "prompt"), _fold(_spaced(f"lower({_strip('raw')})"))),
        "terms": (lambda: norm.normalize_tag(c("raw"), "terms"), character("raw")),
        "compare": (lambda: norm.normalize_tag(c("raw"), "compare"), f"replace(lower({_unescape(_strip('raw'))}), ' ', '_')"),
    }),
    ("b3_parse_tags", PARTS, {"parsed": (lambda: norm.parse_tags(c("tags")), _first(_list("replace(tags, ', ,', ',')", clean)))}),
    ("b4_split_or_single", PARTS, {"listed": (lambda: norm.split_or_single(c("tags")), _list("tags", output)), "single": (lambda: norm.split_or_single(c("source")), f"[{output('source')}]")}),
    ("b5_split_meta", PARTS, {"parts": (lambda: norm.split_meta(c("meta")), f"CASE id % 3 WHEN 0 THEN list_transform(string_split(meta, ' '), lambda t: {output('t')}) WHEN 1 THEN [meta] ELSE {_list('meta', output)} END")}),
    ("b6_format_tags", PARTS, {"text": (lambda: norm.format_tags(c("source")), r"array_to_string(list_transform(regexp_split_to_array(trim(source), '\s+'), lambda t: replace(t, '_', ' ')), ', ')")}),
    ("b7_dedupe_ci", PARTS, {"deduped": (lambda: norm.dedupe_ci(F.split("tags", ",")), f"list_transform(list_filter(list_transform({_list('tags', output)}, lambda t, i: {{'t': t, 'ok': list_position(list_transform({_list('tags', output)}, lambda u: lower(u)), lower(t)) = i}}), lambda s: s.ok), lambda s: s.t)")}),
    ("b8_clean_tag", PARTS, {"escaped": (lambda: norm.clean_tag(c("source"), ["^_^"]), "replace(replace(replace(source, '_', ' '), '(', chr(92) || '('), ')', chr(92) || ')')"), "kept": (lambda: norm.clean_tag(F.lit("^_^"), ["^_^"]), "'^_^'")}),
    ("b9_prefix_tags", PARTS, {"prefixed": (lambda: norm.prefix_tags(F.split(F.concat(F.lit("@a_b,"), c("tags")), ",")), f"list_transform({_list(chr(39) + '@a_b,' + chr(39) + ' || tags', output)}, lambda u: CASE WHEN starts_with(u, '@') THEN u ELSE '@' || u END)")}),
    ("b10_quality_tag", ORDERS, {"quality": (lambda: norm.quality_tag(c("score"), c("rating")), QUALITY)}),
    ("b11_normalize_quality", ORDERS, {"q": (lambda: norm.normalize_quality(F.when(c("id") % 3 == 0, "High_Quality").when(c("id") % 3 == 1, " medium quality ").otherwise(c("rating"))), "CASE id % 3 WHEN 0 THEN 'good quality' WHEN 1 THEN 'normal quality' ELSE replace(lower(trim(rating)), '_', ' ') END")}),
    ("b12_is_quality", PARTS, {"yes": (lambda: norm.is_quality(F.concat(c("meta"), F.when(c("id") % 2 == 0, " Quality").otherwise(""))), "id % 2 = 0"), "known": (lambda: norm.is_quality(F.lit(" Masterpiece ")), "true")}),
    ("b13_period_tag", ORDERS, {"period": (lambda: norm.period_tag(c("created")), PERIOD)}),
    ("b14_year_tag", ORDERS, {"year": (lambda: norm.year_tag(c("created")), YEAR)}),
    ("b15_safety_tags", ORDERS, {"safety": (lambda: norm.safety_tags(c("rating")), SAFETY)}),
    ("b16_normalize_rating", ORDERS, {"r": (lambda: norm.normalize_rating(c("rating")), RATING)}),
    ("b17_iso_created_at", ORDERS, {"iso": (lambda: norm.iso_created_at(c("created")), ISO_CREATED)}),
    ("b18_display_name", PARTS, {"shown": (lambda: norm.display_name(c("source")), output(r"regexp_replace(source, '[\s_]*\([^)]*\)', '', 'g')")), "key": (lambda: norm.character_key(c("source")), character("source"))}),
    ("b19_candidate_keys", PARTS, {"keys": (lambda: norm.candidate_keys(c("raw")), _first("[raw, " + _unescape("trim(raw)") + ", lower(" + _unescape("trim(raw)") + "), " + stats("raw") + ", replace(" + stats("raw") + ", ' ', '_')]"))}),
    ("b20_set_quality", PARTS, {"out": (lambda: norm.set_quality(F.concat(F.lit("best quality, "), c("meta"), F.lit(", odd quality, z. low quality, rest\n")), "masterpiece"), "concat('masterpiece, ', array_to_string(list_filter(list_transform(string_split(meta, ','), lambda t: trim(t)), lambda t: t <> ''), ', '), ', z. low quality, rest', chr(10))"),
                                "plain": (lambda: norm.set_quality(F.concat(c("meta"), F.lit(", low quality\n")), "good quality"), "concat('good quality, ', array_to_string(list_transform(string_split(meta, ','), lambda t: trim(t)), ', '), chr(10))")}),
    ("b21_combined_text", PARTS, {"text": (lambda: norm.combined_text(c("meta"), c("source")), "meta || '. ' || source")}),
    ("c29_stable_tags", PARTS, {"sorted_tags": (lambda: norm.stable_tags(F.split("tags", ",")), "list_transform(list_sort(list_transform(string_split(tags, ','), lambda t: {'k': lower(t), 't': t})), lambda s: s.t)")}),
]


def _make(source: str, columns: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = "part" if "{part}" in source else "orders"
        return sql(spark, sf_dir, source.replace("{string}", "string"), table).select("id", *[f().alias(n) for n, (f, _) in columns.items()])

    return run


for _name, _source, _columns in SCALARS:
    _from = _source.replace("{part}", "part").replace("{orders}", "orders").replace("{string}", "VARCHAR")
    register(_name, _make(_source, _columns), f"SELECT id, {', '.join(f'{x} AS {n}' for n, (_, x) in _columns.items())} FROM ({_from}) src")
