"""Operators that learn: held-out accuracy, and parts against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import language_id, quality_crf, toxicity
from tests.llm.common import by_id, docs, empty

SF = "/root/testdata/sf0.01"


def held_out(df, truth, column):
    rows = df.join(truth, "doc_id").where("held_out").select(F.avg((F.col(column) == F.col("truth")).cast("double")).alias("a")).first()
    return rows.a


def test_toxicity_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.toxicity(d, labels)
    assert out.count() == d.count()
    assert out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert held_out(out, labels.select("doc_id", F.col("toxic").alias("truth")), "predicted") > 0.93


def vectors_of(texts, df, n):
    """Unit TF-IDF vectors by their definition, as dicts."""
    out = []
    for t in texts:
        v = {w: (1 + math.log(k)) * math.log((1 + n) / (1 + df.get(w, 0))) for w, k in Counter(toxicity.words(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / norm for w, x in v.items()} if norm else {})
    return out


def test_nearest_by_brute_force_over_all_terms(spark):
    """Neighbours of passages and of words, their order, ties and copies, against plain cosines."""
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    df = Counter(w for t in texts.values() for w in set(toxicity.words(t)))
    held, _ = toxicity.fit(d, labels, k=9)
    index = held.value
    df = {w: n for w, n in df.items() if w in index.place}  # other words count as unseen
    examples = dict(zip(index.ids.tolist(), vectors_of([texts[i] for i in index.ids.tolist()], df, len(texts)), strict=True))
    toxic = dict(zip(index.ids.tolist(), index.y.tolist(), strict=True))
    assert len(examples) == labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id").distinct().count()
    for i in list(texts)[::40]:
        words = toxicity.words(texts[i])
        for part in toxicity.passages(words):
            q = vectors_of([" ".join(part)], df, len(texts))[0]
            sims = {e: sum(x * v.get(w, 0.0) for w, x in q.items()) for e, v in examples.items()}
            want = sorted((s for s in sims.values() if s > 0), reverse=True)[:9]
            at, got = index.nearest(*index.vector(Counter(part)))
            assert np.allclose(got, want, atol=1e-9)
            assert all(abs(sims[e] - s) < 1e-9 for e, s in zip(index.ids[at].tolist(), got, strict=True))
            key = int(index.keys[at[0]])
            assert key not in index.keys[index.nearest(*index.vector(Counter(part)), key)[0]].tolist()
        for w in words[:3]:
            if w in index.place:
                near = sorted(((v[w], e) for e, v in examples.items() if w in v), key=lambda x: (-x[0], x[1]))[:9]
                up = sum(s / near[0][0] * toxic[e] for s, e in near) + toxicity.PRIOR * index.share
                want = up / (sum(s / near[0][0] for s, _ in near) + toxicity.PRIOR)
                assert abs(index.word_votes[index.place[w]] - want) < 0.02  # equal weights may be cut at another place
                assert abs(index.votes_of(np.array([index.place[w]]))[0] - index.word_votes[index.place[w]]) < 1e-12


def test_passages_cover_the_words():
    for n in (0, 1, 5, 1024, 1025, 5000):
        words = [str(i) for i in range(n)]
        parts = toxicity.passages(words)
        assert [w for p in parts for w in p] == words
        assert all(0 < len(p) <= toxicity.PASSAGE for p in parts)


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.languages(d, max_labelled=300, max_windows=1200)
    assert held_out(out, d.select("doc_id", F.col("lang").alias("truth")), "lang_pred") > 0.97


def test_language_samples_every_language_and_whole_texts(spark):
    rows = [(i, "the same words again and again", "en") for i in range(900)] + [(1000 + i, "x" * 6000 + " ñandú qué", "es") for i in range(4)]
    seen = []

    class Net(language_id.Network):
        def train(self, x, y, **_):
            seen.append((x, y))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_id, "Network", Net)
        net = language_id.fit(spark.createDataFrame(rows + rows[:900] * 3, "doc_id long, text string, lang string"), held_out=4, max_labelled=20, max_windows=480)
    x, y = seen[0]
    assert net.languages == ["en", "es"]
    assert (y == 0).sum() == 10 and (y == 1).sum() == 4 * 24
    assert any("ñandú".encode() in w.tobytes() for w in x)  # after the first 4096 characters


def test_network_gradients():
    net = language_id.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    g = net.gradients(x, y)
    loss = lambda: -np.log(net.predict(x)[np.arange(5), y]).mean()
    for name, at in (("conv", (3, 1)), ("bias", (2,)), ("out", (4, 1)), ("off", (0,)), ("embed", (int(x[0, 10]), 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_network_forward_by_plain_loops():
    net = language_id.Network(["a", "b", "c"])
    rng = np.random.default_rng(5)
    net.p["bias"], net.p["off"] = rng.normal(size=len(net.p["bias"])), rng.normal(size=3)
    x = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    got = net.predict(x)
    for row, probs in zip(x, got, strict=True):
        pooled = []
        for i, w in enumerate(language_id.WIDTHS):
            for f in range(i * language_id.FILTERS, (i + 1) * language_id.FILTERS):
                best = -math.inf
                # Every filter takes the positions that the widest one has.
                for t in range(language_id.WINDOW - max(language_id.WIDTHS) + 1):
                    best = max(best, sum(float(net.p["embed"][row[t + j]] @ net.p["conv"][j * language_id.EMBED : (j + 1) * language_id.EMBED, f]) for j in range(w)))
                pooled.append(max(0.0, best + net.p["bias"][f]))
        z = np.array(pooled) @ net.p["out"] + net.p["off"]
        z = np.exp(z - z.max())
        assert np.allclose(probs, z / z.sum(), atol=1e-4)


@pytest.mark.parametrize(("text", "letter"), [(None, False), ("", False), ("½ ² ① 12 _ —", False), ("½a", True), ("  ñ", True), ("١٢", False), ("中", True)])
def test_letters(text, letter):
    assert language_id.has_letter(text) == letter


def test_windows_cover_the_text():
    text = "é" * 300
    x, n = language_id.windows(text)
    assert n.sum() == 600
    assert b"".join(r[:k].tobytes() for r, k in zip(x, n, strict=True)).decode() == text


def test_quality_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_crf.quality(d, labels)
    assert held_out(out, labels.select("doc_id", F.col("quality").alias("truth")), "predicted") > 0.93


def test_field_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    field = quality_crf.Field(3)
    field.w, field.step = rng.normal(size=3), rng.normal(size=(2, 2))
    chains = [rng.normal(size=(n, 3)) for n in (1, 4, 6, 1, 9)]
    first = quality_crf.starts_of(np.array([len(c) for c in chains]))
    good, pairs = field.marginals(np.concatenate(chains) @ field.w, first)
    start = 0
    for c in chains:
        weights, labels = [], []
        for code in range(1 << len(c)):
            y = [(code >> t) & 1 for t in range(len(c))]
            weights.append(np.exp(sum(c[t] @ field.w * y[t] for t in range(len(c))) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False))))
            labels.append(y)
        p = np.array(weights) / sum(weights)
        assert np.allclose(good[start : start + len(c)], p @ np.array(labels))
        for t in range(1, len(c)):
            want = np.zeros((2, 2))
            for w, y in zip(p, labels, strict=True):
                want[y[t - 1], y[t]] += w
            assert np.allclose(pairs[start + t], want)
        start += len(c)


def test_field_on_one_long_chain():
    """Messages by blocks against messages line by line, with strong potentials."""
    rng = np.random.default_rng(6)
    field = quality_crf.Field(1)
    field.step = np.array([[4.0, -6.0], [-5.0, 3.0]])
    unary = rng.normal(0, 8, 5003)
    good, _ = field.marginals(unary, quality_crf.starts_of(np.array([5003])))
    a, b = np.zeros((5003, 2)), np.zeros((5003, 2))
    u = np.stack([np.zeros(5003), unary], 1)
    a[0] = u[0]
    for t in range(1, 5003):
        a[t] = u[t] + np.logaddexp(a[t - 1, 0] + field.step[0], a[t - 1, 1] + field.step[1])
    for t in range(5001, -1, -1):
        b[t] = np.logaddexp(field.step[:, 0] + u[t + 1, 0] + b[t + 1, 0], field.step[:, 1] + u[t + 1, 1] + b[t + 1, 1])
    want = 1 / (1 + np.exp(np.clip((a + b)[:, 0] - (a + b)[:, 1], -500, 500)))
    assert np.allclose(good, want)


def test_field_gradient_raises_the_likelihood():
    rng = np.random.default_rng(7)
    sizes, y = np.array([3, 1, 40, 2]), np.array([1, 0, 1, 0])
    x = np.concatenate([rng.normal(1.0 if k else -1.0, 1, (n, quality_crf.N_OWN)) for n, k in zip(sizes, y, strict=True)])
    field = quality_crf.Field(3 * quality_crf.N_OWN)
    field.train(x, sizes, y)
    good, _ = field.marginals(quality_crf.with_neighbours(x, quality_crf.starts_of(sizes)) @ field.w, quality_crf.starts_of(sizes))
    assert ((good > 0.5) == (np.repeat(y, sizes) == 1)).mean() > 0.95


def test_long_documents_are_learned_from_whole(spark):
    """The middle of a document of many lines reaches the training, as one chain, and the labelled rows are bounded by number."""
    text = "\n".join(f"Line number {i} says so." for i in range(700))
    rows = [(i, text if i % 2 else "a | b | c\n" * 300) for i in range(8)]
    d = spark.createDataFrame(rows + rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    seen = []

    class Field(quality_crf.Field):
        def train(self, x, sizes, y, **_):
            seen.append(sizes)
            super().train(x, sizes, y, epochs=5)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_crf, "Field", Field)
        quality_crf.fit(d, labels, held_out=4)
        quality_crf.fit(d, labels, held_out=4, max_labelled=3)
    assert sorted(seen[0].tolist()) == [300] * 4 + [700] * 4
    assert all(len(s) <= 3 for s in seen[1:])


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows_and_tables(spark, data, labelled):
    d = docs(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    labels = (labels if labelled else labels.limit(0)).unionAll(spark.createDataFrame([(None, 1, 1), (900006, None, None)], "doc_id long, quality int, toxic int"))
    for out in (toxicity.toxicity(d, labels), quality_crf.quality(d, labels), language_id.languages(d, max_labelled=60, max_windows=200)):
        got = by_id(out)
        assert sum(map(len, got.values())) == d.count()
        assert all(0 <= r.score <= 1 for rows in got.values() for r in rows)
        assert len(got[900006]) == 2
        assert not got[None][0].held_out
    langs = by_id(language_id.languages(d, max_labelled=60, max_windows=200))
    assert {langs[i][0].lang_pred for i in (900002, 900003, 900004)} == {"und"}
    for out in (toxicity.toxicity(empty(spark), labels), quality_crf.quality(empty(spark), labels), language_id.languages(empty(spark))):
        assert out.count() == 0
