"""Operator 12: centroid clustering, the nearest centroid by the threshold algorithm.

Vectors are integers, so that distances, sums and centroids are exact and no result depends on the order of rows. The
centroids of a round are sorted once for each dimension. From a vector's value every one of these lists is walked
outward, one centroid of each dimension in a step, the nearer side first; a centroid that a walk meets for the first time
has its exact distance taken. What no walk has met is in every dimension at least as far as the last one met there, so once
the sum of the squares of these frontiers strictly exceeds the best exact distance, the best is final; at equality the
walk goes on, since a centroid of a smaller number could tie. Vectors of a batch walk together, and those that are done
drop out.

A round is one pass over the vectors, which sends a row for each task and non-empty centroid to the sums: nothing is
shuffled by vector or cluster, so copies and large clusters are no hot keys. The driver holds the k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import checkpoint

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Rows that walk at once; their frontiers are rows x dimensions.
ROWS = 4096
#: Components below this in size, so that squared distances of `DIMENSIONS` of them fit a long.
LIMIT = 1 << 27


def usable(vector: Column, dimensions: int, scale: int) -> Column:
    """Whether a vector has so many components, none null or non-finite, and none of `LIMIT` or more once scaled."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LIMIT))  # false for NaN, which is the largest number
    return F.coalesce((F.size(vector) == dimensions) & fits, F.lit(False))


def sorted_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the centroids' values in ascending order, and their numbers."""
    order = np.argsort(centroids, axis=0, kind="stable")
    return np.take_along_axis(centroids, order, 0).T.copy(), order.T.copy()


def nearest(vectors: np.ndarray, centroids: np.ndarray, steps: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector, ties to the smaller number.

    steps, if given, gets the number of exact distances that were taken.
    """
    n, k, dims = len(vectors), len(centroids), vectors.shape[1]
    values, numbers = sorted_lists(centroids)
    # Positions of the next centroid below and above each value.
    high = np.stack([np.searchsorted(values[d], vectors[:, d]) for d in range(dims)], 1) if n else np.zeros((0, dims), np.int64)
    low = high - 1
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    met = np.zeros((n, k), bool)
    todo, at = np.arange(n), np.arange(dims)
    while len(todo):
        x, lo, hi = vectors[todo], low[todo], high[todo]
        below = np.where(lo >= 0, x - values[at, np.maximum(lo, 0)], np.iinfo(np.int64).max)
        above = np.where(hi < k, values[at, np.minimum(hi, k - 1)] - x, np.iinfo(np.int64).max)
        down = below <= above
        frontier = np.where(down, below, above)
        found = numbers[at, np.where(down, lo, hi)]
        low[todo], high[todo] = lo - down, hi + ~down
        fresh = np.zeros((len(todo), k), bool)
        fresh[np.arange(len(todo))[:, None], found] = True
        fresh &= ~met[todo]
        met[todo] |= fresh
        for c in np.flatnonzero(fresh.any(0)):
            rows = todo[fresh[:, c]]
            distance = ((vectors[rows] - centroids[c]) ** 2).sum(1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = distance[better], c
        if steps is not None:
            steps.append(int(fresh.sum()))
        todo = todo[((frontier**2).sum(1) <= best[todo]) & ~met[todo].all(1)]
    return cluster, best


def _vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and scaled integers of every `ROWS` rows of a batch of usable vectors."""
    column = batch.column("vector")
    for i in range(0, batch.num_rows, ROWS):
        part = column.slice(i, ROWS)
        yield i, np.floor(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64).reshape(len(part), -1)


def _sums(kept: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """For each non-empty centroid the number of its vectors and their componentwise sums."""
    k, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x in _vectors(batch, scale):
                cluster, _ = nearest(x, centroids)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(0)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["c", "n", "total"])

    parts = kept.select("vector").mapInArrow(run, "c long, n long, total array<long>")
    add = [F.sum(F.get("total", F.lit(d)).cast("decimal(20,0)")).alias(f"d{d}") for d in range(dims)]
    return {r.c: (int(r.n), [int(r[f"d{d}"]) for d in range(dims)]) for r in parts.groupBy("c").agg(F.sum("n").alias("n"), *add).collect()}


def seeds(kept: DataFrame, k: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest hash of their ids, in the order of hashes; equal ids by their components, null ids last."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    ints = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = kept.select(key.alias("key"), ints.alias("x")).orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def fit(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The centroids after the rounds; kept has usable vectors."""
    centroids = seeds(kept, k, scale)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in _sums(kept, centroids, scale).items():
            centroids[c] = [s // n for s in total]
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of every row of kept."""
    kinds = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _vectors(batch, scale):
                cluster, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(i, len(x)), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, kinds)


def _summary(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row for each centroid that has vectors: inertia of its cluster and of all, and a digest of it."""
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    top = (1 << 63) - 1
    fits = lambda v: v if v <= top else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, fits(s), fits(sum(sums.values())), digest(c)) for c, s in sums.items()]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def clusters(embeddings: DataFrame, column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row of embeddings (vec_id, `column`).

    Null vectors, vectors with another number of components or with null or non-finite ones, and those with a component of
    2**27 or more in size once scaled, whose distances no long could hold, are left out. Fewer vectors than k give as many
    centroids as vectors; a sum of distances beyond a long is null. Repeated rows count and are returned as often as they
    occur, an empty table gives an empty result; extra columns are ignored.
    """
    kept = embeddings.select("vec_id", F.col(column).alias("vector")).where(usable(F.col("vector"), dimensions, scale))
    centroids = fit(kept, k, rounds, scale)
    if not len(centroids):
        nothing = F.lit(None)
        return kept.select("vec_id", nothing.cast("int").alias("cluster"), *[nothing.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], nothing.cast("string").alias("centroid_sha256"))
    found = checkpoint(assign(kept, centroids, scale))
    # At most k rows.
    return found.join(F.broadcast(_summary(kept.sparkSession, found, centroids)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """DuckDB SQL for `clusters` over the table embeddings, by plain distances to all centroids."""
    finite = f"NOT list_contains(list_transform(embedding, lambda v: coalesce(isfinite(v::DOUBLE) AND abs(v::DOUBLE * {scale}) < {LIMIT}, false)), false)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda v: floor(v::DOUBLE * {scale})::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, x) - 1 AS c, x AS y FROM (SELECT sha256('1:' || vec_id) AS key, x FROM kept ORDER BY key, x LIMIT {k}))",
    ]
    distance = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(vec_id) AS vec_id, min(x) AS x, min(struct_pack(d := {distance}, c := c)) AS m FROM kept, c{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT m.c AS c, unnest(range(1, {dimensions + 1})) AS d, unnest(x) AS v FROM a{i})")
            steps.append(f"s{i} AS (SELECT c, d, sum(v)::HUGEINT AS s, count(*) AS n FROM u{i} GROUP BY c, d)")
            steps.append(f"n{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS y FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN n{i} USING (c))")
    last = f"SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m.c"
    return "WITH " + ",\n".join(steps) + "\n" + last
