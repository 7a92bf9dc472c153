"""The pipeline's stages against what each is to do, and run() against the stages by brute force."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import decontamination, pii, quality_rules, shingle_sets
from tests.llm.common import by_id, docs, oracle_rows
from tests.llm.test_exact import base_spans, closure, fingerprint


def test_stages_keep_columns_on_odd_rows(spark, data):
    df = docs(spark, data)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, data)
        assert out.columns == df.columns, name
        assert out.count() <= df.count()
        stage(spark, df.limit(0), data).count()
    assert corpus_pipeline.STAGES[-1][1](spark, df, data).count() == df.count()


def test_one_document_of_each_group_stays(spark, data):
    df = docs(spark, data)
    left = by_id(corpus_pipeline.near_duplicates(spark, df, data))
    fps = {r.doc_id: fingerprint(r.text or "") for r in df.where("doc_id is not null").collect()}
    find = closure(set(fps.values()))
    groups = {}
    for i, f in fps.items():
        groups.setdefault(find(f), set()).add(i)
    assert set(left) - {None} == {min(g) for g in groups.values()}
    assert all(len(rows) == 1 for i, rows in left.items())


def test_near_duplicates_by_five_word_similarity(spark, data):
    """Pairs on both sides of 0.8, chains, copies and a large group, against all pairs by brute force."""
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((8, 40, 150, 400)))]
        texts.append(" ".join(base))
        for _ in range(30 if g == 0 else 6):
            other = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                other[rng.randrange(len(other))] = f"v{rng.randrange(4000)}"
            texts.append(" ".join(other[rng.randrange(3) :]))
            base = other if rng.random() < 0.5 else base
    texts += ["", " ", "one two", "One  two", "one three"]
    cut = [t.lower().split() for t in texts]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in cut]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a | b and len(a & b) >= 0.8 * len(a | b)):
                close += a != b and bin(fingerprint(texts[i]) ^ fingerprint(texts[j])).count("1") > 2
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert close > 20  # pairs that the fingerprints' two bits don't link
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, data).collect()} == {find(i) for i in range(len(texts))}


def test_near_copies_below_the_limit_make_no_pairs(spark, data, monkeypatch):
    """Copies of one text that share many bands but are pairwise below 0.8 are hardly held against each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        other = list(base)
        for i in (20, 60, 90, 120):
            other[i] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    texts += [texts[0] + " more", texts[1] + " more"]
    held, confirm = [], shingle_sets.confirm

    def counted(pairs, *rest):
        held.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(shingle_sets, "confirm", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_sets.near_duplicates(df).collect()}
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) >= 0.8 * len(a | b)}
    find = closure_of(len(texts), near)
    assert got == {i: find[i] for i in range(len(texts))}
    assert sum(held) < 4 * len(texts)


def test_all_texts_within_two_bits_meet(spark, monkeypatch):
    """Without any band: similar texts with one fingerprint, or with ones of two bits' distance, whatever the smallest of them are."""
    rng = random.Random(7)
    texts = []
    for family in range(5):
        base = [f"w{family}x{i}" for i in range(150)]
        for _ in range(6):
            other = list(base)
            other[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    order = rng.sample(range(30), 30)
    sketches = shingle_sets.sketches
    # 0, 1 and 3 differ in two bits at most; repeats give one set two fingerprints.
    fp, none = F.get(F.array(*map(F.lit, (0, 1, 3))), (F.col("doc_id") % 3).cast("int")).cast("long"), F.array().cast("array<long>")
    monkeypatch.setattr(shingle_sets, "sketches", lambda docs, width: sketches(docs, width).withColumns({"fp": fp, "bands": none}))
    df = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)] + [(30, texts[0]), (31, texts[9])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_sets.near_duplicates(df).collect()}
    want = {order[i]: min(order[i // 6 * 6 : i // 6 * 6 + 6]) for i in range(30)}
    assert got == want | {30: want[order[0]], 31: want[order[9]]}


def closure_of(n, pairs):
    """The smallest number that pairs reach from each of n."""
    least, changed = list(range(n)), True
    while changed:
        changed = False
        for i, j in pairs:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    return least


def test_quality_stage_by_plain_rules(spark, data):
    """What SQL keeps stays, without the lines that fail by rules written out in Python."""
    columns, rows = oracle_rows(quality_rules.ORACLE, data, ["documents"])
    want = {r[columns.index("doc_id")] for r in rows if r[columns.index("kept")]}
    d = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r.text or "" for r in d.collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, d, data).collect()}
    assert set(after) == want
    for i, text in after.items():
        good = []
        for line in text_lines(before[i]):
            n, chars = len(line.encode().split()), len(line)
            seps, count = sum(line.count(x) for x in "|»›"), lambda s, t=line: sum(t.count(x) for x in s)
            bad = count("#*$%&|<>") * 100 > chars * 10 or (n >= 3 and line.count("!") * 100 > n * 60) or (seps >= 3 and n - seps <= (seps + 1) * 3)
            bad = bad or any(b in line.lower() for b in quality_rules.BOILERPLATE) or (n >= 30 and not count(".,;:!?…。"))
            if not (n and bad):
                good.append(line)
        assert text == "\n".join(good)


def text_lines(text):
    return text.split("\n")


def test_decontamination_stage_by_plain_search(spark, data):
    """Documents with a normalised item as a substring go; those that share no eight words with any item stay."""
    d = spark.read.parquet(f"{data}/documents.parquet")
    items = [decontamination.normalise(r.text).decode() for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    grams = {" ".join(w[k : k + 8]) for t in items for w in [t.split()] for k in range(len(w) - 7)}
    left = {r.doc_id for r in corpus_pipeline.decontaminate(spark, d, data).collect()}
    for r in d.collect():
        norm = decontamination.normalise(r.text).decode()
        if any(f" {t} " in f" {norm} " for t in items if t):
            assert r.doc_id not in left
        elif not any(" ".join(w[k : k + 8]) in grams for w in [norm.split()] for k in range(len(w) - 7)):
            assert r.doc_id in left


def test_run_equals_its_parts(spark, data):
    out = corpus_pipeline.run(spark, data)
    got = by_id(out)
    assert all(len(rows) == 1 for rows in got.values())
    d = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, data)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in d.collect()}
    spans = {r.doc_id: r.spans for r in pii.personal_data(d).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        cut, at = "", 0
        assert {f"{k}:{a}:{b}" for k, a, b in base_spans(text)} <= set(spans[i].split(","))  | {""}
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)]
        for kind, a, b in sorted(every, key=lambda s: (s[1], s[2])):
            if a >= at:
                cut += text[at:a] + f"<{kind}>"
            at = max(at, b)
        ids = lib.encode(cut + text[at:], add_eos=True)
        assert got[i][0].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_over_no_documents(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_different_texts_of_one_id_and_repeated_rows(spark, data):
    """Each text is judged by itself: one id with two texts keeps both, equal rows become one, a nameless copy goes."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a, "x"), (5, b, "x"), (5, a, "x"), (5, a, "w"), (9, a + " more", "y"), (None, b, "z"), (None, "alone here it is", "z"), (None, "alone here it is", "z"), (3, None, "n"), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n.x` string")
    left = sorted(map(str, (tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, data).collect())))
    assert left == sorted(map(str, [(5, a, "w"), (5, b, "x"), (None, "alone here it is", "z"), (3, None, "n")]))
