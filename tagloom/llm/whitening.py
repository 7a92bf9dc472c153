"""Operator 13: whitening of embeddings by polarisation covariance.

Entries are scaled to integers. The variance of a sum of two dimensions is the sum of their variances and twice their
covariance, so the variances of all dimensions and of all sums of two give every covariance without a cross product:
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. What is aggregated are the squares of centred values, exactly: a task
centres by the floor of the mean, which keeps the integers small, and the rest of the mean is taken out of the sums in
integers of any size. So the covariances are rationals until they are rounded once each, and assembled for `eigh`.

Each distinct vector is fitted once: copies meet in a distinct with partial aggregation first. Each of three passes over the
distinct vectors makes one row for each task, of d * (d + 1) / 2 numbers at most, and these are added in tasks again before
the driver, which holds the d x d matrix, gets them. Rows are whitened where they are, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import checkpoint

SCALE = 256
COMPONENTS = 4
ROWS = 2048
#: Below this in size, centred values of `ROWS` rows can be squared and added as longs.
SMALL = 1 << 24
LONG = 1 << 63
#: A component whose eigenvalue is at most this share of the trace is no direction of the data.
FLAT = 1e-12


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector has entries, none null or non-finite, and none beyond a long once scaled."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(1 << 62))), F.lit(False))


def centred(x: np.ndarray, floors: list[int]) -> np.ndarray:
    """x minus the floors of the means, as longs where these can be squared and added, else as integers of any size."""
    if not len(x) or (int(x.max()) < SMALL and int(x.min()) > -SMALL and max(map(abs, floors)) < SMALL // 2):
        z = x - np.array(floors, np.int64)
        if not len(x) or int(np.abs(z).max()) < SMALL:
            return z
    return x.astype(object) - np.array(floors, object)


def pair_sums(z: np.ndarray) -> list[list[int]]:
    """Row i holds the sum of squares of dimension i, then those of its sums with each later dimension."""
    out = []
    for i in range(z.shape[1]):
        both = z[:, i:] + z[:, i : i + 1]
        both[:, 0] = z[:, i]
        out.append([int(s) for s in (both * both).sum(0)])
    return out


def covariance(n: int, rests: list[int], sums: list[list[int]]) -> list[list[Fraction]]:
    """The matrix from n, the sums of what the floors of the means leave, and the summed squares.

    The sum of (z - r / n)**2 over n values z with sum r is that of z**2 minus r**2 / n.
    """
    d = len(rests)
    var = [Fraction(n * sums[i][0] - rests[i] ** 2, n * n) for i in range(d)]
    out = [[Fraction(0)] * d for _ in range(d)]
    for i in range(d):
        out[i][i] = var[i]
        for j in range(i + 1, d):
            both = Fraction(n * sums[i][j - i] - (rests[i] + rests[j]) ** 2, n * n)
            out[i][j] = out[j][i] = (both - var[i] - var[j]) / 2
    return out


def _lists(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.column(name).slice(i, ROWS)
            yield i, batch, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _added(parts: DataFrame) -> list[int]:
    """The sums by place of rows of integers in decimal digits, all of one length; by way of about a root as many rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int] = []
        for batch in batches:
            for row in batch.column("sums").to_pylist():
                sums = [a + int(b) for a, b in zip(sums or [0] * len(row), row, strict=True)]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([list(map(str, sums))])], ["sums"])

    n = math.isqrt(parts.rdd.getNumPartitions()) + 1
    rows = parts.repartition(n).mapInArrow(run, "sums array<string>").collect()
    return [sum(map(int, place)) for place in zip(*(r.sums for r in rows), strict=True)]


def _totals(fitted: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums for each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, _, x in _lists(batches, "x"):
            n += len(x)
            total = [a + int(b) for a, b in zip(total, centred(x, [0] * d).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([list(map(str, [n, *total]))])], ["sums"])

    n, *total = _added(fitted.select("x").mapInArrow(run, "sums array<string>"))
    return n, total


def _squares(fitted: DataFrame, floors: list[int]) -> list[list[int]]:
    """The summed squares of all dimensions and of all sums of two, as `pair_sums` has them."""
    d = len(floors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (d - i) for i in range(d)]
        for _, _, x in _lists(batches, "x"):
            sums = [[a + b for a, b in zip(old, new, strict=True)] for old, new in zip(sums, pair_sums(centred(x, floors)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(s) for row in sums for s in row]])], ["sums"])

    sums = iter(_added(fitted.select("x").mapInArrow(run, "sums array<string>")))
    return [[next(sums) for _ in range(d - i)] for i in range(d)]


def project(x: np.ndarray, floors: list[int], rest: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """x - mean on the axes; the mean is the floors and a rest below 1."""
    return (centred(x, floors).astype(np.float64) - rest) @ axes


def deviations(z: np.ndarray, n: int, rests: list[int]) -> list[int | None]:
    """The sums of (n * x - S)**2 over the dimensions, which is (n * z - r)**2; None beyond a long.

    Longs are exact but for multiples of 2**64, so they are right wherever the sum surely fits one.
    """
    about = ((float(n) * z.astype(np.float64) - np.array([float(r) for r in rests])) ** 2).sum(1) / LONG
    sure = about < 0.99
    if z.dtype == object:
        sure[:] = False
        off = z
    else:
        off = np.int64(n) * z - np.array(rests, np.int64)
    out = (off * off).sum(1).tolist()
    for i in np.flatnonzero(~sure):
        exact = sum((n * int(v) - r) ** 2 for v, r in zip(z[i], rests, strict=True)) if about[i] < 1.01 else LONG
        out[i] = exact if exact < LONG else None
    return out


def _identity_error(fitted: DataFrame, n: int, floors: list[int], rest: np.ndarray, axes: np.ndarray) -> float:
    """The largest entry in size of the covariance of the whitened fit list minus the identity."""
    k = axes.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for _, _, x in _lists(batches, "x"):
            w = project(x, floors, rest, axes)  # centred, since x is
            total, products = total + w.sum(0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), *products.ravel().tolist()]])], ["sums"])

    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k + k * k)]
    found = np.array(fitted.select("x").mapInArrow(run, "sums array<double>").agg(*sums).collect()[0]) / n
    cross = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return float(np.abs(cross - np.eye(k)).max())


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every remaining row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are those with an entry that no
    long holds once scaled, and those of another length than the most frequent one (of equally frequent ones the longest),
    which have no place in one matrix. Components are at most as many as dimensions. One whose eigenvalue is no more than
    1e-12 of the trace, as when all vectors are equal, has a null `whitened` and no part in identity_error; without any
    other, identity_error is null, and `explained` is null where the trace is zero. A deviation beyond a long is null. Repeated
    rows give repeated results but one entry of the fit list, an empty table an empty result; extra columns are ignored.
    """
    spark = embeddings.sparkSession
    ints = F.transform("vector", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = embeddings.select("vec_id", F.col(column).alias("vector")).where(usable(F.col("vector"), scale)).select("vec_id", ints.alias("x"))
    out = T.StructType([kept.schema["vec_id"], *[T.StructField(c, k) for c, k in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    length = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not length:
        return spark.createDataFrame([], out)
    kept = kept.where(F.size("x") == length[0].d)
    fitted = checkpoint(kept.select("x").distinct())
    n, total = _totals(fitted, length[0].d)
    floors = [s // n for s in total]
    rests = [s - n * f for s, f in zip(total, floors, strict=True)]
    matrix = np.array([[float(v) for v in row] for row in covariance(n, rests, _squares(fitted, floors))])
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace, rest = float(np.trace(matrix)), np.array([r / n for r in rests])
    firm = values > FLAT * trace
    scaled = axes / np.sqrt(np.where(firm, values, np.nan))
    error = _identity_error(fitted, n, floors, rest, scaled[:, firm]) if firm.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for i, batch, x in _lists(batches, "x"):
            rows, deviation = len(x), deviations(centred(x, floors), n, rests)
            w = project(x, floors, rest, scaled)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").slice(i, rows).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                out.names,
            )

    return kept.mapInArrow(run, out)
