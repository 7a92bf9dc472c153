"""Centroid clustering and whitening against plain loops and numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import centroids, queries, whitening
from tests.llm.common import oracle_rows

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, x int, vector string, cluster string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", "c", 2) for i, v in rows], SCHEMA)


def odd_rows(dims):
    """Vectors that are not used, copies, a repeated row, a row without an id."""
    rng = np.random.default_rng(3)
    real = [(i, rng.normal(0, 0.2, dims).astype(np.float32).tolist()) for i in range(60)]
    bad = [(900, None), (901, [0.5] * (dims - 1)), (902, [NAN] + [0.0] * (dims - 1)), (903, [INF] * dims), (904, [None] + [0.1] * (dims - 1)), (905, []), (906, [0.5] * (dims + 1))]
    return real + bad + [(70 + i, real[0][1]) for i in range(5)] + [real[3], real[3], (None, real[4][1]), (99, [-0.0] * dims)]


def loop_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(near(x)[1], []).append(x)
        for n, xs in members.items():
            cs[n] = [sum(p) // len(xs) for p in zip(*xs)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    of = {}
    for _, c, d in found:
        of[c] = of.get(c, 0) + d
    return [(i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 5, 16, 500])
def test_clusters_equal_plain_loops(spark, k):
    rows = odd_rows(8)
    got = centroids.clusters(table(spark, rows), k=k, dimensions=8)
    assert rows_of(got) == sorted(loop_clusters(rows, k, 3, 8), key=repr)


def test_clusters_equal_the_oracle(spark, data):
    names, want = oracle_rows(centroids.oracle(), data, ["embeddings"])
    assert rows_of(queries.op12_centroids(spark, data).select(*names)) == sorted(want, key=repr)


def test_walk_takes_ties_by_number_and_stops_early():
    rng = np.random.default_rng(5)
    for dims, k, spread in ((1, 40, 30), (2, 60, 12), (3, 16, 2), (6, 9, 1)):
        x, c = rng.integers(-spread, spread + 1, (300, dims)), rng.integers(-spread, spread + 1, (k, dims))
        steps = []
        cluster, distance = centroids.nearest(x, c, steps)
        every = ((x[:, None] - c) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert sum(steps) <= 300 * k
    far = np.arange(0, 100_000, 1000)[:, None]
    steps = []
    centroids.nearest(np.full((50, 1), 52_100), far, steps)
    assert sum(steps) <= 50 * 3


def test_clusters_of_nothing_and_of_too_large_values(spark):
    assert centroids.clusters(table(spark, []), dimensions=2).collect() == []
    assert centroids.clusters(table(spark, [(1, None), (2, [NAN, 1.0])]), dimensions=2).collect() == []
    assert [r.vec_id for r in centroids.clusters(table(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0])]), dimensions=2).collect()] == [2]


def plain_whitening(rows, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(p) for p in zip(*fit)]
    mean = np.array([s / n for s in total])
    z = np.array(fit) - mean
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, n, total, mean, values, axes


@pytest.mark.parametrize("dims", [2, 3, 12])
def test_whitening_equals_numpy(spark, dims):
    rows = odd_rows(dims)
    kept, n, total, mean, values, axes = plain_whitening(rows, dims)
    got = {}
    for r in whitening.whiten(table(spark, rows)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert sum(map(len, got.values())) == len(kept) * min(4, dims)
    signs = {}
    for i, x in kept:
        for c in range(1, min(4, dims) + 1):
            for r in got[i, c]:
                assert (r.n, r.deviation) == (n, sum((n * v - s) ** 2 for v, s in zip(x, total)))
                want = float((np.array(x) - mean) @ axes[:, c - 1]) / math.sqrt(values[c - 1])
                sign = signs.setdefault(c, 1 if want * r.whitened > 0 else -1)
                assert abs(want - sign * r.whitened) < 1e-9
                assert abs(r.explained - values[c - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9


def test_polarised_covariance_is_exact():
    rng = np.random.default_rng(7)
    for size in (50, 1 << 30, 1 << 61):
        x = rng.integers(-size, size, (40, 5))
        n, total = len(x), [int(sum(map(int, c))) for c in x.T]
        floors = [s // n for s in total]
        rests = [s - n * f for s, f in zip(total, floors)]
        got = whitening.covariance(n, rests, whitening.pair_sums(whitening.centred(x, floors)))
        y = [[n * int(v) - s for v, s in zip(row, total)] for row in x]
        assert all(got[i][j] * n**3 == sum(r[i] * r[j] for r in y) for i in range(5) for j in range(5))


def test_deviations_at_the_limit_of_a_long():
    n, rests = 1 << 20, [0, 5]
    z = np.array([[1 << 11, 3], [1489, 2600], [2896, 0], [2897, 0], [1 << 20, 1 << 20], [0, 0]])
    want = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rests)) for row in z]
    assert whitening.deviations(z, n, rests) == [w if w < 1 << 63 else None for w in want]
    assert whitening.deviations(z.astype(object), n, rests) == [w if w < 1 << 63 else None for w in want]


def test_whitening_without_spread(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    flat = whitening.whiten(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])).where(F.col("component") == 2).collect()
    assert [r.whitened for r in line] == [None, None] and all(r.identity_error < 1e-9 for r in line)
