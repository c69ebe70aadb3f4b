"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided
Jacobi directly on the triangular factor.

1. Entries c become whole numbers x = floor(scale * c) + offset.
2. Sums: count and per-dimension sums of x, exact.
3. Scatter: x less the mean rounded to a whole number, so that the products
   are of centred values; the rest of the mean (at most one half) is taken off
   in whole numbers at the end.  All sums are exact, so neither the number of
   tasks nor a repeated task changes a bit of the result.
4. Factor (driver, d x d numbers): covariance V = P L L' P' with diagonal
   pivoting, stopped at the numerical rank r.  One-sided Jacobi rotates the
   columns of L until they are orthogonal: their squared norms are V's
   eigenvalues, the normalised columns (rows put back in order) its
   components.  L'L is never formed, so small eigenvalues keep their digits.
5. Every row is projected; the covariance of the whitened values is measured
   on the written rows.

Rows: a vector that is null or holds null, NaN or infinite entries is dropped;
so is one whose length is not the most frequent one among the rest (the larger
of two equally frequent ones), an empty one included.  Repeated rows and null
ids count as they stand.  Only components within the numerical rank are
returned, as no other direction can be scaled to variance 1: one row, or equal
rows only, give no component and so an empty result, as does an empty table.
An entry beyond 2**52 after scaling is an error.  Only the two named columns
are read.  The driver holds d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.tables import settle

LIMB = 20          # bits of a factor in exact products by floating point
BLOCK = 1 << 12    # rows of a block: 2**20 * 2**20 * 2**12 stays below 2**53
LARGEST = 1 << 52


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _whole(batch: pa.RecordBatch, d: int, scale: int, offset: int) -> np.ndarray:
    """The batch's vectors as whole numbers, one row each."""
    c = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = np.floor(scale * c)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError("an entry is beyond 2**52 after scaling")
    return x.astype(np.int64) + offset


def _blocks(batches: Iterator[pa.RecordBatch], d: int, scale: int, offset: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield _whole(batch.slice(lo, BLOCK), d, scale, offset)


def _sums(d: int, scale: int, offset: int):
    def run(batches):
        total = [0] * d
        for x in _blocks(batches, d, scale, offset):
            # a block's sum stays below 2**12 * 2**53
            high, low = (x >> 30).sum(0), (x & ((1 << 30) - 1)).sum(0)
            total = [t + (int(h) << 30) + int(q) for t, h, q in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "s"])

    return run


def products(z: np.ndarray) -> np.ndarray:
    """z'z as Python integers, exact: z is cut into limbs whose products
    floating point sums without rounding."""
    limbs, rest = [], z
    while True:
        low = rest & ((1 << LIMB) - 1)
        rest = rest >> LIMB
        if ((rest == 0) | (rest == -1)).all():
            limbs.append((low + (rest << LIMB)).astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _scatter(d: int, scale: int, offset: int, centre: np.ndarray):
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d), object)
        for x in _blocks(batches, d, scale, offset):
            total = total + products(x - centre)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(list(total[upper]), pa.decimal128(38, 0))], ["i", "j", "q"])

    return run


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, p) with v[p][:, p] = L L', L of as many columns as v's numerical rank."""
    a, d = v.astype(np.float64).copy(), len(v)
    p, factor = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(np.float64).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        rest = a.diagonal()[k:]
        at = k + int(rest.argmax())
        if not a[at, at] > floor:
            return factor[:, :k], p
        for m in (a, factor):
            m[[k, at]] = m[[at, k]]
        a[:, [k, at]] = a[:, [at, k]]
        p[[k, at]] = p[[at, k]]
        factor[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k:, k:] -= np.outer(factor[k:, k], factor[k:, k])
    return factor, p


def _rounds(r: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of r columns once, in rounds of disjoint pairs."""
    ring = list(range(r)) + ([-1] if r % 2 else [])
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2:]), strict=True) if min(a, b) >= 0]
        out.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """factor times a rotation that makes its columns orthogonal."""
    g = factor.copy()
    if g.shape[1] < 2:
        return g
    rounds, goal = _rounds(g.shape[1]), np.finfo(np.float64).eps * len(g)
    for _ in range(sweeps):
        worst = 0.0
        for a, b in rounds:
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.sqrt(xx * yy)
            worst = max(worst, cosine.max())
            turn = cosine > goal / 4
            zeta = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1), 0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, a], g[:, b] = c * x - c * t * y, c * t * x + c * y
        if worst <= goal:
            return g
    raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")


@dataclass
class Whitening:
    """n rows, exact per-dimension sums of x, and the components by falling
    eigenvalue (columns), the entry of largest size positive."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int
    offset: int


def _eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    factor, p = pivoted_cholesky(v)
    g = jacobi_columns(factor)
    size = np.sqrt((g * g).sum(0))
    order = np.argsort(-size, kind="stable")
    u = np.zeros_like(g)
    u[p] = (g / size)[:, order] if len(size) else g
    if len(size):
        u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return size[order] ** 2, u


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in names]


def _prepared(vectors: DataFrame, column: str, id_column: str) -> DataFrame:
    return _usable(vectors, column).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))


def _length(rows: DataFrame) -> tuple[int, int]:
    """(length, rows) of the most frequent length; (0, 0) without rows."""
    best = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (int(best["d"]), int(best["count"])) if best else (0, 0)


def fit(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", scale: int = 1024, offset: int = 100000) -> Whitening:
    rows = _prepared(vectors, column, id_column)
    d, n = _length(rows)
    if d == 0:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale, offset)
    v = rows.filter(F.size("v") == d).select("v")
    whole = T.DecimalType(38, 0)
    parts = v.mapInArrow(_sums(d, scale, offset), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", whole)]))
    sums = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").cast(whole).alias("s")).collect()}  # d rows
    s = [sums[i] for i in range(d)]
    centre = np.array([(2 * t + n) // (2 * n) for t in s], np.int64)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("q", whole)])
    products_ = v.mapInArrow(_scatter(d, scale, offset, centre), schema).groupBy("i", "j").agg(F.sum("q").cast(whole).alias("q")).collect()  # d * (d + 1) / 2 rows
    left = [t - n * int(c) for t, c in zip(s, centre, strict=True)]
    cov = np.zeros((d, d))
    for r in products_:
        i, j = r["i"], r["j"]
        # n * sum(z z') - (sum z)(sum z)' over n * n, rounded once
        cov[i, j] = cov[j, i] = (n * int(r["q"]) - left[i] * left[j]) / (n * n)
    eigenvalues, components = _eigen(cov)
    return Whitening(n, s, components, eigenvalues, float(np.trace(cov)), scale, offset)


def _project(model: Whitening, k: int):
    n, d = model.n, len(model.sums)
    centre = np.array([(2 * t + n) // (2 * n) for t in model.sums], np.int64)
    left = np.array([t - n * int(c) for t, c in zip(model.sums, centre, strict=True)], object)
    shift = (left / n).astype(np.float64)
    matrix = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def deviations(z: np.ndarray) -> pa.Array:
        far = int(np.abs(z).max(initial=0)) * n + n
        if far * far * d < 1 << 63:
            return pa.array(((n * z - left.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        return pa.array([int(sum(x * x)) for x in n * z.astype(object) - left], pa.decimal128(38, 0))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                z = _whole(part, d, model.scale, model.offset) - centre
                w = (z - shift) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), deviations(z), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))],
                    ["id", "deviation", "whitened"])

    return run


def transform(vectors: DataFrame, model: Whitening, k: int = 8, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Per usable row: id, deviation decimal(38,0), whitened array<double> of
    min(k, rank) values."""
    if k < 1:
        raise ValueError("k must be at least 1")
    id_type = vectors.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    k = min(k, len(model.eigenvalues))
    if k == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = _prepared(vectors, column, id_column)
    return rows.filter(F.size("v") == len(model.sums)).mapInArrow(_project(model, k), schema)


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the k whitened values minus
    the identity, measured over rows (centred sums that Spark merges)."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.select([F.get("whitened", F.lit(i)).alias(f"w{i}") for i in range(k)]).agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(got, pairs, strict=True))


def whiten(vectors: DataFrame, k: int = 8, column: str = "embedding", id_column: str = "vec_id", scale: int = 1024, offset: int = 100000) -> DataFrame:
    """Per usable row and component up to k: id_column, component, n, deviation
    (decimal(38,0): the exact sum over dimensions of (n*x - S)^2), whitened,
    explained, identity_error."""
    model = fit(vectors, column, id_column, scale, offset)
    k = min(k, len(model.eigenvalues))
    rows = settle(transform(vectors, model, max(k, 1), column, id_column), "whitened")
    error = identity_error(rows, k) if k else 0.0
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues[:k])) if k else F.array().cast("array<double>")
    return rows.select(F.col("id").alias(id_column), F.posexplode("whitened").alias("i", "whitened"), "deviation").select(
        id_column, (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
