"""Operators whose results are exact: held against libraries and brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tagloom.llm import decontamination, pii, quality_rules, queries, sentencepiece_bpe, simhash, token_counts, url_filter
from tests.llm.common import by_id, docs, empty, oracle_rows

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_token_counts(spark, data):
    df = docs(spark, data)
    lib = Tokenizer.from_file(WORD)
    want = sorted(str((i, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids))) for i, t in rows_of(df))
    for buckets in (1, 7):
        got = token_counts.token_counts(df, WORD, buckets=buckets).collect()
        assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(empty(spark), WORD).count() == 0


def test_sentencepiece(spark, data):
    df = docs(spark, data)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows_of(df):
        ids = lib.encode(t, add_eos=True)
        want.append(str((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))))
    got = sentencepiece_bpe.encode_digests(df, PIECE).collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(want)
    assert sentencepiece_bpe.encode_digests(empty(spark), PIECE).count() == 0


def test_sentencepiece_spans_and_round_trip(spark):
    model, lib = sentencepiece_bpe.load(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab  ▁\n\té字😀<s>x41 thofi\x00Σ") for _ in range(rng.randint(0, 90)))
        ids, spans = model.encode(text)
        pieces = lib.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in pieces]
        assert spans == [(p.begin, p.end) for p in pieces]
        assert model.decode(ids) == lib.decode(ids)
    df = spark.createDataFrame([(1, "Über  all"), (2, None)], "doc_id long, text string")
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(df, PIECE), PIECE).collect()
    assert {r.doc_id: r.text for r in back} == {1: "Über  all", 2: ""}


def test_long_units_merge_as_short_ones():
    model = sentencepiece_bpe.load(PIECE)
    unit = "thetionerring" * 4
    assert model.merge_one(model.start(unit).tolist()) == model.merge_many([unit])[0]


@pytest.mark.parametrize("text", ["ＡＢＣ　①㌔ x", "  a  b ", "ﬁ é é", "Å\u200b x", "\t\n x", "", "   "])
def test_character_map(text):
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_bpe.pb.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    norm, source = sentencepiece_bpe.Normalizer(spec.normalizer_spec).align(text)
    want, offsets = lib.normalize(text, with_offsets=True)
    assert norm == want
    begins = [0]
    for ch in norm:
        begins.append(begins[-1] + len(ch.encode()))
    assert [len(text.encode()[: source[b]].decode()) for b in begins] == list(offsets)


def fingerprint(text):
    """The definition, word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, threshold=2):
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= threshold:
                parent[find(a)] = find(b)
    return find


def test_simhash(spark, data):
    df = docs(spark, data)
    pairs = [(i, fingerprint(t)) for i, t in rows_of(df)]
    find = closure({f for _, f in pairs})
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = sorted(str((i, f"{f:016x}", least.get(find(f)))) for i, f in pairs)
    got = simhash.near_duplicates(df).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 5])
def test_simhash_links_miss_no_pair(spark, block):
    """Clusters of near fingerprints, chains of them, and random ones, for several covering codes."""
    rng = random.Random(block)
    fps = {0, 1, 3, 7, 15, 31, 63, 127, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, 2, block).collect()]
    assert set(got) == want
    roots = {r.fp: r.root for r in simhash.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    find = closure(fps)
    groups = {}
    for f in fps:
        if signed(f) in roots:
            groups.setdefault(find(f), set()).add(roots[signed(f)])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_replicas_are_not_broadcast(spark):
    """Spark sizes the replicas by the few rows that they are made of; they are many times as many."""
    df = simhash.links(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_personal_data(spark, data):
    more = ["a@b.c-d_e@f.g", "1.2.3.4.5.6.7.8 001.002.003.0004", "😀 4111-1111-1111-1111 4111 1111 1111 1112", "1.1.1.1 " * 600, "+12345678", "@@a@b..c @ a@b"]
    df = docs(spark, data).select("doc_id", "text").unionAll(spark.createDataFrame([(800000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    want = []
    for i, t in rows_of(df):
        found = base_spans(t)
        text = ",".join("%s:%d:%d" % s for s in found)
        want.append(str((i, *[sum(s[0] == k for s in found) for k in pii.KINDS], hashlib.sha256(text.encode()).hexdigest())))
    got = pii.personal_data(df).collect()
    assert sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == sorted(want)
    assert pii.personal_data(empty(spark)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"so please call me: +1 (555) 123-45{i:02d} now") for i in range(8)] + [(50, "do call me: (555) 123-9999 now"), (51, "only 12345678 here"), (52, "year 2024 call me: no")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert spans[50] == "phone:12:26"
    assert spans[51] == spans[52] == ""
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[0] == "so please call me: <phone> now"
    assert masked[50] == "do call me: <phone> now"
    assert masked[51] == "only 12345678 here"


def test_pattern_scores_by_brute_force(spark):
    """Confidence, promotion and rounds of the pattern graph against plain loops."""
    rng = random.Random(8)
    rows = []
    for kind in ("phone", "key"):
        # A chain of patterns: each shares most of its values with the one before, of which the first has seeds.
        for p in range(6):
            for v in range(p * 4, p * 4 + 8):
                rows.append((kind, f"p{p}", f"v{v}", v < 8))
        for _ in range(120):
            v = rng.randrange(60)
            rows.append((kind, f"q{rng.randrange(12)}", f"v{v}", v < 8))
        rows += [(kind, "rare", "v0", True), (kind, "rare", "v1", True)] * 5
    got = {(r.kind, r.pattern): (r.confidence, r.round) for r in pii.score_patterns(spark.createDataFrame(rows, "kind string, pattern string, value string, seed boolean"), 0.4, 5, 3).collect()}
    edges = {(k, p, v) for k, p, v, _ in rows}
    seeds = {(k, v) for k, _, v, s in rows if s}
    score = {(k, v): float((k, v) in seeds) for k, _, v in edges}
    want, held = {}, -1
    for turn in range(1, 6):
        promoted = {}
        for k, p in {(k, p) for k, p, _ in edges}:
            s = [score[k, v] for kk, pp, v in edges if (kk, pp) == (k, p)]
            if len(s) >= 3 and sum(s) / len(s) >= 0.4 and sum(x >= 0.4 for x in s) >= 3:
                promoted[k, p] = (sum(s) / len(s), want.get((k, p), (0, turn))[1])
        want = promoted
        if len(promoted) == held:
            break
        held = len(promoted)
        for k, v in score:
            if (k, v) not in seeds:
                miss = 1.0
                for kk, pp, vv in edges:
                    if (kk, vv) == (k, v) and (kk, pp) in promoted:
                        miss *= 1 - min(promoted[kk, pp][0], 1 - 1e-9)
                score[k, v] = 1 - miss
    assert got.keys() == want.keys()
    assert max(r for _, r in want.values()) > 2
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_promoted_instances_support_other_patterns(spark):
    """Seeds teach `token =`; what that finds teaches `secret is`, which finds what no seed stands beside."""
    rows = [(100 + i, f"here token = {i:039x}f") for i in range(40)]
    rows += [(i, f"there token = abc-{i}-defghijk or my secret is abc-{i}-defghijk") for i in range(8)]
    rows += [(20, "but my secret is zyx-9-wvutsrq"), (21, "chapter-12-introduction stays")]
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == "key:13:53"
    assert spans[20] == "key:17:30"
    assert spans[21] == ""


def test_keys_and_accounts_alone(spark):
    """A key with an issuer's prefix or a right account number is a span without any pattern; other strings are not."""
    key, account, digest = "ghp_" + "Ab1" * 12, "DE89370400440532013000", "ab" * 20
    rows = [(1, f"one {key} here"), (2, "x " * 50_000 + f"an {account} there"), (3, f"commit {digest} stays"), (4, f"bad {account[:-1]}1 stays"), (5, f"{key} {account}")]
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans == {1: f"key:4:{4 + len(key)}", 2: "iban:100003:100025", 3: "", 4: "", 5: f"key:0:{len(key)},iban:{len(key) + 1}:{len(key) + 23}"}
    assert {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()} == {1: "one <key> here"}


def test_patterns_find_what_no_seed_looks_like(spark):
    """Lower-case digests support the pattern; upper-case and other strings in it are found, the same ones elsewhere are not."""
    rows = [(100 + i, f"text {i} token = \"{i:039x}f\" more") for i in range(30)] + [(1, 'say TOKEN = "9F3A27C1D4E8B6055A0C7E93F1D28B46" end'), (2, "plain 9F3A27C1D4E8B6055A0C7E93F1D28B46 end"), (3, 'the token = "q7Xz2LpV9sKd4" end')]
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[1] == "key:13:45" and spans[3] == "key:13:26" and spans[2] == ""


def test_account_numbers(spark):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    df = spark.createDataFrame([(good,), (bad,), ("DE89370400440532013000",), ("DE89370400440532013001",)], "t string")
    assert [r.ok for r in df.select(pii._iban(F.col("t")).alias("ok")).collect()] == [True, False, True, False]
    rows = [(i, f"pay to account {t} today") for i, t in enumerate(("GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "NL91ABNA0417164300", bad))]
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("iban:15:" in s for s in spans.values())


def test_mask_of_many_spans(spark):
    """A long text with thousands of spans, wide characters among them, against plain replacement."""
    rng = random.Random(9)
    text = " y ".join(rng.choice(["wörd", "😀", "a.b@c.de", "+1 (555) 123-4567", "10.0.0.25", "x"]) for _ in range(3000))
    got = pii.mask(spark.createDataFrame([(1, text), (2, None), (3, "a.b@c.de"), (4, "")], "doc_id long, text string"))
    want = text.replace("a.b@c.de", "<email>").replace("+1 (555) 123-4567", "<phone>").replace("10.0.0.25", "<ip>")
    assert {r.doc_id: r.text for r in got.collect()} == {1: want, 2: None, 3: "<email>", 4: ""}


def test_mask_keeps_columns_and_overlaps_once(spark, data):
    df = docs(spark, data)
    out = pii.mask(df)
    assert out.columns == df.columns
    assert out.count() == df.count()
    text = by_id(out)[900001][0].text
    assert text.startswith("Hello <email>, call <phone> or <card>; 10.0.0.256 and <ip>.")


def test_quality_rules_equal_sql(spark, data):
    columns, want = oracle_rows(quality_rules.ORACLE, data, ["documents"])
    got = queries.op10_quality_rules(spark, data).select(*columns).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_quality_rules_on_odd_rows(spark, data):
    df = docs(spark, data)
    got = by_id(quality_rules.quality_rules(df))
    for i in (900002, 900003, 900004):
        assert (got[i][0].n_words, got[i][0].kept) == (0, False)
    assert got[900008][0].n_repeat_words == 9000
    assert got[900001][0].n_dup_lines == 1
    assert len(got[900006]) == 2
    cleaned = quality_rules.clean(df)
    assert cleaned.columns == df.columns
    assert cleaned.count() == sum(r.kept for rows in got.values() for r in rows)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_repeated_words_by_definition(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = rows[r.doc_id][1].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)}
        assert r.n_repeat_words == len(hit)


def test_clean_drops_failing_lines(spark):
    good = ["This is a good line with enough words, and it ends well.", "Another one follows here. It says other things too.", "The last of them closes the text, as it should."]
    rows = [(1, f"{good[0]}\nHome | About | Contact | Help\n{good[1]}\nAccept our cookie policy\n{good[2]}"), (2, "A | B | C | D | E | F | G | H | I | J | K")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_lost for r in quality_rules.quality_rules(df).collect()}[1] == 11
    assert {r.doc_id: r.text for r in quality_rules.clean(df).collect()} == {1: "\n".join(good)}


PASSAGE = "The quick brown fox jumps over the lazy dog while seven curious cats watch from the garden wall in silence and wonder"


def edit_distance_in(pattern, text):
    """Fewest edits of pattern against any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, data):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "Tiny answer"), (3, None), (None, PASSAGE), (4, "")], "item_id long, text string")
    near = PASSAGE.replace("curious", "curous").replace("brown", "brawn")
    far = " ".join(w[::-1] for w in PASSAGE.split())
    rows = [(1, "Intro. " * 50 + PASSAGE + " outro" * 50), (2, f"<b>{PASSAGE.upper()}!!</b>"), (3, "start " + near + " end"), (4, far), (5, None), (6, ""), (7, "a tiny, answer!"), (8, "a tiny odd answer"), (9, "x" * 50_000), (10, PASSAGE.replace(" ", " !! "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(df, bench).collect()}
    # The item without an id has the text of item 1.
    assert got == {(1, 1): 0, (2, 1): 0, (3, 1): 2, (7, 2): 0, (10, 1): 0} | {(i, None): e for i, e in ((1, 0), (2, 0), (3, 2), (10, 0))}
    kept = decontamination.decontaminate(docs(spark, data), bench)
    assert kept.count() == docs(spark, data).count()
    assert decontamination.contaminated(empty(spark), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(df, bench).count() == 5


def test_lemma_filter_misses_no_alignment():
    rng = random.Random(2)
    patterns = decontamination.Patterns([(1, PASSAGE)])
    (grams, _), = patterns.grams
    grams.parts, patterns.grams = grams.parts[:1], [(decontamination.Grams(12, grams.parts[:1]), [1])]
    part, budget = grams.parts[0].decode(), int(grams.edits[0])
    for k in range(60):
        text = list(part)
        for _ in range(rng.randint(0, budget + 3)):
            at = rng.randrange(len(text))
            kind = rng.randrange(3)
            text[at : at + 1] = [] if kind == 0 else [text[at], rng.choice("abc")] if kind == 1 else [rng.choice("abc")]
        whole = "noise before " + "".join(text) + " noise after"
        norm = decontamination.normalise(whole).decode()
        want = edit_distance_in(part, norm)
        found = patterns.search(whole)
        assert {i: e for i, (e, _) in found.items()} == ({1: want} if want <= budget else {}), k


def test_patterns_of_every_length(spark):
    """Short items with edits, parts of items, and hits across segments, against edit distances by brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    for n in (1, 2, 3, 5, 12, 24):
        item = " ".join(word() for _ in range(n))
        patterns = decontamination.Patterns([(1, item)])
        for _ in range(5):
            text = list(item)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(text)) if text else 0
                text[at : at + 1] = rng.choice(([], ["z"], ["q", "z"]))
            whole = " ".join([word() for _ in range(rng.randrange(12))] + ["".join(text)] + [word() for _ in range(9)])
            padded = f" {decontamination.normalise(whole).decode()} "
            want = []
            for grams, _ in patterns.grams:
                want += [e for p, k in zip(grams.parts, grams.edits, strict=True) if (e := edit_distance_in(p.decode(), padded)) <= k]
            found = patterns.search(whole)
            assert found == ({1: (min(want), len(want))} if want else {})


def test_parts_and_segments():
    item = " ".join(f"w{i}{i * 7 % 13}" for i in range(90))
    patterns = decontamination.Patterns([(7, item)])
    half = item[: len(item) // 2]
    assert patterns.of[7] > 3
    for lead in (0, decontamination.SEGMENT - 100, decontamination.SEGMENT, 3 * decontamination.SEGMENT - 50):
        edits, parts = patterns.search("y " * (lead // 2) + half + " z" * 40)[7]
        assert edits == 0 and 0 < parts < patterns.of[7]
    assert patterns.search("y " * 20_000 + item)[7] == (0, patterns.of[7])


def test_repetitive_text_and_item():
    patterns = decontamination.Patterns([(1, "ab cd " * 60)])
    assert patterns.search("ab cd " * 20_000)[1][0] == 0
    assert patterns.search("ab ce " * 20_000) == {}
    assert patterns.search("ab cd ef " * 3_000) == {}


def test_blocks_of_a_large_benchmark(spark):
    bench = spark.createDataFrame([(i, f"{i} {PASSAGE}") for i in range(9)], "item_id long, text string")
    parts = list(decontamination.blocks(bench, limit=3 * len(PASSAGE) + 30))
    assert len(parts) >= 3
    assert [i for b in parts for i, _ in b] == list(range(9))


def url_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best[0] if best else None, best[1] if best else None


def test_url_rules(spark, data):
    odd = [None, "", "no scheme/x", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/en/", "http://a.example.com/en/1", "http://www.example.com/en/1", "http://xnet/es/", "http://a.net/es/#q", "http://a.net/fr", "s://h?u=://x", "http://a.net:80/es/", "http://É.com/"]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").unionAll(spark.createDataFrame([(9000 + i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string"))
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    for r in pages.collect():
        host, path, rule, verdict = url_rule(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == (verdict or g.verdict)
        assert g.verdict in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_distrust_spreads_against_links(spark):
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(9)] + [(20, "http://friend.org/a", link("bad.net") * 9), (21, "http://friend.org/b", link("BAD.net") * 9), (30, "http://good.com/a", link("ok.org")), (31, "http://ok.org/a", ""), (32, "http://alone.org/a", None)]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), threshold=0.2).collect()}
    assert got[20].verdict == got[21].verdict == "block"
    assert got[31].verdict == got[32].verdict == "allow"
    assert got[31].trust > 0
    # The same ranks by plain iteration.
    hosts = ["bad.net", "friend.org", "good.com", "ok.org", "alone.org"]
    edges = {("friend.org", "bad.net"): 18.0, ("good.com", "ok.org"): 1.0} | {(h, h): 1.0 for h in hosts}
    seeds, d = {"bad.net": 9.0}, {"bad.net": 9.0}
    for _ in range(url_filter.ROUNDS):
        new = {h: 0.15 * seeds.get(h, 0.0) for h in hosts}
        for (a, b), w in edges.items():
            new[a] += 0.85 * d.get(b, 0.0) * w / sum(x for (_, q), x in edges.items() if q == b)
        d = new
    assert abs(got[20].distrust - d["friend.org"] / 2) < 1e-9


def test_links_and_tree_are_told_apart(spark):
    """A made-up web: a ring of sites links to blocked ones, a subdomain has no link at all."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/">' for h in hosts)
    rows = [(i, f"http://spam{i}.net/es/x", link(f"spam{(i + 1) % 4}.net")) for i in range(4)]
    rows += [(10 + i, f"http://farm{i}.org/", link("spam0.net", "spam1.net", "spam2.net", f"farm{(i + 1) % 3}.org")) for i in range(3)]
    rows += [(20 + i, f"http://site{i}.org/", link("good.com", f"site{(i + 1) % 3}.org")) for i in range(3)]
    rows += [(30, "http://good.com/", link("site0.org")), (40, "http://sub.spam0.net/", ""), (50, None, link("spam0.net")), (30, "http://good.com/", link("site0.org"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = {r.page_id: r for r in url_filter.url_verdicts(df, tree=0.0).collect()}
    both = {r.page_id: r for r in url_filter.url_verdicts(df, tree=1.0).collect()}
    assert [links[10 + i].verdict for i in range(3)] == ["block"] * 3
    assert [links[20 + i].verdict for i in range(3)] == ["allow"] * 3
    assert links[20].trust > 0 and links[20].trust == links[20].link_trust
    assert links[40].distrust == 0 and both[40].distrust > 0 and both[40].link_distrust == 0
    assert all(abs(both[k].link_distrust - links[k].distrust) < 1e-12 for k in (0, 10, 20, 30) if links[k].distrust is not None)


def test_links_without_a_scheme(spark):
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://a.org/", "<a href='//Bad.net/x'>" * 9), (3, "http://b.org/", '<img src="/local//bad.net/x"><p data-x="//bad.net">')]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].distrust > 0 and got[2].verdict == "block"
    assert got[3].distrust == 0 and got[3].verdict == "allow"
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_of_one_host(spark):
    """A host with most pages is dealt to all partitions, each page once."""
    rows = [(i, f"http://big.org/{i}", "") for i in range(200)] + [(1000 + i, f"http://h{i}.org/", "") for i in range(40)]
    out = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r.page_id for r in out.collect()) == sorted(r[0] for r in rows)
