"""Operator 4: personal data by bootstrapped contextual extraction, with SQL functions only.

Base extraction finds e-mail addresses, IPv4 addresses, payment cards and telephone numbers by their formats. These
are seeds, as are access keys with a prefix that an issuer publishes and account numbers (IBAN) with a right check number, which
are spans of their own wherever they stand, and lower-case hexadecimal strings of 40 digits, which are not: alone they may be
anything, so they only support patterns. Other strings that could be identifiers of a kind by their form are its candidates. Seeds and candidates are the
instances; the words around an instance are its lexical patterns: the two and the three before it, the two after it, and
one on either side. Another span of the same kind counts as one word, as do the ends of the text; nothing is cut.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the mean score of its distinct
instances; it is promoted if that reaches `min_confidence` and at least `min_seeds` distinct instances reach it too. An
instance's score is 1 for a seed and else the noisy-or of its promoted patterns, so promoted instances are seeds of the
next round, in which they support the other patterns around them. Scores only grow; the rounds end when no pattern is
promoted any more, or after `rounds`. What stands in a promoted pattern is a span of its kind, beside the base ones.

Offsets are code points. Matches and the text between them give offsets by running sums, in blocks, so that a text of
many matches costs little more than its length; candidates are held against base spans in one sorted pass. Only spans,
candidates and their few words of context are shuffled. A null text counts as empty and has no spans. Repeated rows give
repeated results, an empty table an empty one; overlapping spans of different kinds are all given, and masked as one;
extra columns are ignored by `personal_data` and passed through by `mask`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import checkpoint

KINDS = ("email", "ip", "card", "phone")
# Java forms of the base patterns: possessive and started only where a run starts or the last match ended, which
# finds the same matches in time that grows with the text. The second item must be in a text that has a match.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Kinds that only the method finds.
MORE_KINDS = ("key", "iban")
#: Strings that may be identifiers: a word with @, digit groups, colon-separated hexadecimal groups; words of letters and digits; account numbers.
CANDIDATES = {
    "numbers": r"(?:\G|(?<![^\x20\x09-\x0D]))(?:[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]++|[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|(?:[0-9A-Fa-f]{1,4}+::?){2,}+[0-9A-Fa-f]{0,4}+)",
    "keys": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+",
    "accounts": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: The form that an instance of a kind must have, and where it is looked for.
FORMS = {
    "email": ("numbers", r"^[^@]+@[^@]+$"),
    "ip": ("numbers", r"^(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f]{0,4}$"),
    "card": ("numbers", r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$"),
    "phone": ("numbers", r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$"),
    "key": ("keys", ""),
    "iban": ("accounts", ""),
}
#: Access keys by the prefixes that issuers publish.
KEY_SEED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
#: Strings that support a pattern of keys and are no span by themselves.
KEY_SUPPORT = r"^[0-9a-f]{40}$"
BLOCK = 256


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All prefix results of step over an array; arrays grow by blocks, so this isn't quadratic."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    inner = lambda acc, block: F.aggregate(block, F.array(F.element_at(F.element_at(acc, -1), -1)), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x)))
    done = F.aggregate(blocks, F.array(F.array(zero)), lambda acc, block: F.array_append(acc, inner(acc, block)))
    return F.when(n > 0, F.flatten(F.transform(done, lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))))).otherwise(F.array().cast("array<int>"))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return (F.length(digits) >= 16) & (F.length(digits) <= 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return (F.length(digits) >= 8) & (F.length(digits) <= 15)
    return F.lit(True)


def _iban(value: Column) -> Column:
    """Whether the check number is right: the value with its first four characters last, letters as 10 to 35, is 1 modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4))), "")
    digit = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    return F.aggregate(turned, F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise((a * F.when(digit(ch) > 9, 100).otherwise(10) + digit(ch)) % 97)) == 1


def _sides(gap: Column) -> Column:
    """The first two and the last three words of the text between two matches, in lower case."""
    words = F.array(F.array_remove(F.split(F.lower(gap), r"[\x20\x09-\x0D]+"), ""))
    last = lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))
    return F.get(F.transform(words, lambda w: F.struct(F.slice(w, 1, 2).alias("first"), last(w).alias("last"))), F.lit(0))


def _matches(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Add column `name`: all matches as array<struct<start, end, value, left, right>>; left and right are the words around."""
    df = df.select("*", F.when(guard, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).alias("_m"))
    df = df.select("*", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).alias("_gaps"))
    df = df.select("*", F.transform("_m", lambda m: F.length(m)).alias("_mlen"), F.transform("_gaps", lambda g: F.length(g)).alias("_glen"), F.transform("_gaps", _sides).alias("_sides"))
    df = df.select("*", F.when(F.size("_m") > 0, running(F.zip_with("_mlen", F.slice("_glen", F.lit(1), F.size("_m")), lambda a, b: a + b), F.lit(0), lambda a, x: a + x)).alias("_ends"))
    mark = F.lit(f"<{name}>")
    left = lambda i: F.concat(F.array(F.when(i > 0, mark).otherwise("^")), F.get("_sides", i)["last"])
    right = lambda i: F.concat(F.get("_sides", i + 1)["first"], F.array(F.when(i + 1 < F.size("_m"), mark).otherwise("$")))
    out = F.transform(
        "_m",
        lambda m, i: F.struct((F.get("_ends", i) - F.length(m)).alias("start"), F.get("_ends", i).alias("end"), m.alias("value"), left(i).alias("left"), right(i).alias("right")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:array<string>,right:array<string>>>")
    return df.select("*", F.coalesce(F.when(F.size("_m") > 0, out), empty).alias(name)).drop("_m", "_gaps", "_mlen", "_glen", "_ends", "_sides")


def _free(df: DataFrame, name: str) -> DataFrame:
    """Column `name` without what overlaps a base span: in the order of starts, what ended before and what starts next decide."""
    far = (1 << 31) - 1
    spans = F.concat(F.col("_bases"), F.transform(name, lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), i.alias("i"))))
    df = df.select("*", F.when((F.size("_bases") > 0) & (F.size(name) > 0), F.array_sort(spans)).alias("_s"))
    before = running(F.transform("_s", lambda s: F.when(s["i"] < 0, s["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    after = F.reverse(running(F.reverse(F.transform("_s", lambda s: F.when(s["i"] < 0, s["start"]).otherwise(far))), F.lit(far), lambda a, x: F.least(a, x)))
    df = df.select("*", F.when(F.col("_s").isNotNull(), before).alias("_before"), F.when(F.col("_s").isNotNull(), after).alias("_after"))
    # Zipped, as a running array that a lambda refers to once would be built again for every element.
    apart = F.filter(F.arrays_zip("_s", "_before", "_after"), lambda z: (z["_s"]["i"] >= 0) & (z["_before"] <= z["_s"]["start"]) & (z["_after"] >= z["_s"]["end"]))
    free = F.when(F.col("_s").isNotNull(), F.transform(apart, lambda z: F.get(name, z["_s"]["i"]))).otherwise(F.col(name))
    return df.select(*[free.alias(name) if c == name else f"`{c}`" for c in df.columns if c not in ("_s", "_before", "_after")])


def extract(docs: DataFrame) -> DataFrame:
    """docs and, per kind, its base spans, and the candidates that overlap no base span; _stamp tells texts apart."""
    df = docs.select("*", F.coalesce("text", F.lit("")).alias("_text"))
    df = df.select("*", F.xxhash64("_text").alias("_stamp"), F.col("_text").rlike("[0-9]").alias("_digit"))
    for kind, (pattern, needs) in PATTERNS.items():
        guard = F.contains(F.col("_text"), F.lit(needs)) if needs else F.col("_digit")
        if kind == "ip":
            guard = F.col("_text").rlike(r"[0-9]\.[0-9]")
        df = _matches(df, kind, pattern, guard & (F.lit(True) if kind == "email" else F.col("_digit")))
        df = df.withColumn(kind, F.filter(kind, lambda s: _valid(kind, s["value"])))
    df = df.select("*", F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("i"))) for k in KINDS]).alias("_bases"))
    guards = {"numbers": F.col("_digit") | F.contains(F.col("_text"), F.lit("@")) | F.contains(F.col("_text"), F.lit("::")), "keys": F.col("_digit"), "accounts": F.col("_text").rlike("[A-Z]{2}[0-9]{2}")}
    for name, pattern in CANDIDATES.items():
        df = _free(_matches(df, name, pattern, guards[name]), name)
    return df.drop("_bases", "_digit")


def occurrences(found: DataFrame) -> DataFrame:
    """A row for each span or candidate, kind it could have, and pattern around it."""
    row = lambda k, base, own, seed, s: F.struct(F.lit(k).alias("kind"), F.lit(base).alias("base"), own.alias("own"), seed.alias("seed"), s.alias("s"))
    yes, no = F.lit(True), F.lit(False)
    tagged = [F.transform(k, lambda s: row(k, True, yes, yes, s)) for k in KINDS]
    for k in (*KINDS, *MORE_KINDS):
        name, form = FORMS[k]
        fits = F.filter(name, lambda c: c["value"].rlike(form)) if form else F.col(name)
        own = {"key": lambda s: s["value"].rlike(KEY_SEED), "iban": lambda s: _iban(s["value"])}.get(k, lambda s: no)
        seed = (lambda s: own(s) | s["value"].rlike(KEY_SUPPORT)) if k == "key" else own
        tagged.append(F.transform(fits, lambda s: row(k, False, own(s), seed(s), s)))
    rows = found.select("doc_id", "_stamp", F.explode(F.concat(*tagged)).alias("x")).select("doc_id", "_stamp", "x.kind", "x.base", "x.own", "x.seed", "x.s.*")
    ending = lambda n: F.slice("left", F.size("left") - (n - 1), F.lit(n))
    before = [F.when(F.size("left") >= n, F.concat_ws(" ", F.lit(f"{n} before"), ending(n))) for n in (2, 3)]
    after = F.when(F.size("right") >= 2, F.concat_ws(" ", F.lit("2 after"), F.slice("right", 1, 2)))
    around = F.concat_ws(" ", F.lit("around"), F.element_at("left", -1), F.get("right", F.lit(0)))
    patterns = F.array_compact(F.array(*before, after, around))
    return rows.select("doc_id", "_stamp", "kind", "base", "own", "seed", "start", "end", F.lower("value").alias("value"), F.explode(patterns).alias("pattern"))


def score_patterns(occ: DataFrame, min_confidence: float = 0.8, rounds: int = 4, min_seeds: int = 3) -> DataFrame:
    """(kind, pattern, confidence, round) of the promoted patterns; round is the first in which a pattern is one.

    Patterns with fewer than `min_seeds` distinct instances can never be promoted and are left out first.
    """
    edges = occ.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    some = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds)
    edges = checkpoint(edges.join(some.drop("n"), ["kind", "pattern"], "left_semi"))
    seeds = checkpoint(edges.groupBy("kind", "value").agg(F.max("seed").alias("seed")))
    scores = seeds.select("kind", "value", F.col("seed").cast("double").alias("score"))
    out, held = None, -1
    for k in range(1, rounds + 1):
        confidence = edges.drop("seed").join(scores, ["kind", "value"]).groupBy("kind", "pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= min_confidence).alias("n"))
        good = confidence.where((F.col("confidence") >= min_confidence) & (F.col("n") >= min_seeds)).select("kind", "pattern", "confidence", F.lit(k).alias("round"))
        if out is not None:
            first = out.select("kind", "pattern", F.col("round").alias("_r"))
            good = good.join(first, ["kind", "pattern"], "left").select("kind", "pattern", "confidence", F.coalesce("_r", "round").alias("round"))
        out = checkpoint(good)
        n = out.count()
        if n == held:
            break
        held = n
        miss = edges.drop("seed").join(out, ["kind", "pattern"]).groupBy("kind", "value").agg(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(1 - 1e-9)))).alias("miss"))
        scores = checkpoint(seeds.join(miss, ["kind", "value"], "left").select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.coalesce("miss", F.lit(0.0)))).alias("score")))
    return out


def discover(occ: DataFrame, min_confidence: float = 0.8, rounds: int = 4, min_seeds: int = 3) -> DataFrame:
    """(doc_id, _stamp, kind, start, end, round) of spans beside the base ones.

    Round 0 are keys and account numbers recognised by themselves; the others are what promoted patterns find, and their first round.
    """
    patterns = score_patterns(occ, min_confidence, rounds, min_seeds)
    at, more = ["doc_id", "_stamp", "kind", "start", "end"], occ.where(~F.col("base"))
    found = more.join(patterns, ["kind", "pattern"]).select(*at, "round").unionAll(more.where("own").select(*at, F.lit(0).alias("round")))
    return found.groupBy(*at).agg(F.min("round").alias("round"))


def _spans(docs: DataFrame, min_confidence: float, rounds: int, min_seeds: int) -> tuple[DataFrame, DataFrame]:
    """Base spans per document, and those that the patterns add."""
    found = checkpoint(extract(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "_stamp", *KINDS, *CANDIDATES))
    return found.select("doc_id", "_stamp", *KINDS), discover(occurrences(found), min_confidence, rounds, min_seeds)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, (*KINDS, *MORE_KINDS))), kind).cast("int")


def personal_data(docs: DataFrame, min_confidence: float = 0.8, rounds: int = 4, min_seeds: int = 3) -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256, spans (base and discovered) and n_spans for every row of docs."""
    found, more = _spans(docs, min_confidence, rounds, min_seeds)
    more = more.groupBy(F.col("doc_id").alias("_id"), F.col("_stamp").alias("_s")).agg(F.collect_list(F.struct(_rank(F.col("kind")).alias("k"), "start", "end", "kind")).alias("more"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.concat(*[F.transform(k, lambda s: F.struct(F.lit(i + 1).alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))) for i, k in enumerate(KINDS)])
    df = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_stamp") == F.col("_s")), "left")
    df = df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), "more")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,start:int,end:int,kind:string>>")))))
    df = df.select("doc_id", *[f"n_{k}" for k in KINDS], "base", every.alias("every"))
    joined = lambda name: F.array_join(F.transform(name, text), ",")
    return df.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"), F.size("every").cast("long").alias("n_spans"))


def mask(docs: DataFrame, min_confidence: float = 0.8, rounds: int = 4, min_seeds: int = 3) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; overlapping spans become one, named for the first."""
    found, more = _spans(docs, min_confidence, rounds, min_seeds)
    base = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))) for k in KINDS])
    spans = found.select("doc_id", "_stamp", F.explode(base).alias("s")).select("doc_id", "_stamp", "s.*").unionAll(more.select("doc_id", "_stamp", "start", "end", "kind")).distinct()
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("_stamp").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    # The row travels whole in one column, so its own columns can have any names.
    text = F.col("text")
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text, F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    df = df.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_s")), "left")
    reach = F.when(F.col("_spans").isNotNull(), running(F.transform("_spans", lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x)))
    df = df.select("*", reach.alias("_reach"))
    # Spans that no earlier one reaches open a place; what is kept stands between the reach of one place and the start of the next.
    reached = lambda i: F.when(i > 0, F.get("_reach", i - 1)).otherwise(0)
    opens = F.filter(F.transform("_spans", lambda s, i: F.struct(reached(i).alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))), lambda p: p["from"] <= p["to"])
    df = df.select("*", opens.alias("_places"))
    # A substring is found by counting from the start, so places are taken from stretches of the text, about a root of their number each.
    n = F.ceil(F.sqrt(F.size("_places"))).cast("int")
    starts = F.sequence(F.lit(0), F.size("_places") - 1, n)
    stretch = F.transform(starts, lambda i: F.struct(F.slice("_places", i + 1, n).alias("places"), F.get("_places", i)["from"].alias("from"), F.element_at(F.slice("_places", i + 1, n), -1)["to"].alias("to")))
    stretch = F.transform(stretch, lambda x: F.struct(x["places"].alias("places"), x["from"].alias("from"), F.substring("text", x["from"] + 1, x["to"] - x["from"]).alias("part")))
    piece = lambda x: F.array_join(F.transform(x["places"], lambda p: F.concat(F.substring(x["part"], p["from"] - x["from"] + 1, p["to"] - p["from"]), F.lit("<"), p["kind"], F.lit(">"))), "")
    masked = F.concat(F.array_join(F.transform(stretch, piece), ""), F.substring(text, F.element_at("_reach", -1) + 1, F.length("text")))
    masked = F.when(F.size("_places") > 0, masked).otherwise(text)
    return df.select(*[(masked if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
