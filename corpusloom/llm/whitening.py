"""Embedding whitening by spectral divide and conquer (QDWH).

Vectors are put on a lattice, x = floor(64 c) + 1000000, so that counts, sums and second moments are integers and
the covariance over the distinct vectors is exact and the fit is the same whatever the order of tasks (a row's whitened
values can differ in their last bits with the batch it is multiplied in).  Three passes run
over the written table of distinct vectors: number and sums, second moments of vectors centred at the nearest
integers to the mean (the rest of the centring is exact arithmetic on integers), and the covariance of the whitened
vectors as a check.  Tasks multiply blocks of rows small enough that double arithmetic on them is exact, and hand on
one matrix each; Spark adds them up.  Only matrices of the vectors' dimension reach the driver.

There the eigenvectors are found by divide and conquer: the polar factor of A - s I, by the dynamically weighted Halley
iteration (QDWH), is U = sign(A - s I); (I + U) / 2 projects on the subspace of the eigenvalues above s.  Orthonormal bases
of it and of its complement split A into two smaller matrices, and so on down to single components.  The map to the
leading components is broadcast with the tasks' function and applied to every row.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of another
length than most have (of equally many, the longer).  Entries beyond 2^40 count as 2^40.  Components without variance are
whitened to null, as are deviations that do not fit a long.  Repeated rows each give their rows; they weigh once in the
fit.  Null ids stay.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Entries are cut to this size before they are scaled.
LARGEST = float(1 << 40)
#: Rows that are multiplied at once.
STRIPE = 8192


# --- polar decomposition and spectral divide and conquer -------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by the QDWH iteration."""
    n = len(a)
    bound = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    if bound == 0:
        return np.eye(n)
    x = a / bound
    # Lower bound of the least singular value: that of the triangular factor, by the norm of its inverse.
    r = np.linalg.qr(x, mode="r")
    least = np.abs(np.diag(r)).min()
    low = 1e-16 if least < 1e-15 else max(0.9 / np.linalg.norm(np.linalg.inv(r)), 1e-16)
    low = min(low, 1.0)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
            after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.cholesky(np.eye(n) + wc * (x.T @ x))
            solved = np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
            after = wb / wc * x + (wa - wb / wc) * solved
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        moved = np.linalg.norm(after - x)
        x = (after + after.T) / 2
        if moved < 1e-14 * n or (abs(1 - low) < 1e-15 and moved < 1e-5):
            break
    return x


def divided(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first k columns span the eigenvalues above a shift, and k; None where nothing can be split."""
    n, scale = len(a), np.abs(a).sum(axis=1).max()
    middle = np.trace(a) / n
    spread = np.sqrt(((a - middle * np.eye(n)) ** 2).sum() / n)
    if spread <= 4 * np.finfo(float).eps * scale:
        return None
    # The mean lies between the outer eigenvalues; other shifts are for an eigenvalue that falls on one.
    for step in (0.0, 0.21, -0.21, 0.43, -0.43, 0.07, -0.07, 0.013, -0.013, 0.0031):
        sign = polar(a - (middle + step * spread) * np.eye(n))
        k = round((n + np.trace(sign)) / 2)
        if not 0 < k < n:
            continue
        above = (np.eye(n) + sign) / 2
        basis = above @ rng.standard_normal((n, k))
        for _ in range(2):
            basis = above @ np.linalg.qr(basis)[0]
        v = np.linalg.qr(basis, mode="complete")[0]
        if np.abs(v[:, k:].T @ a @ v[:, :k]).max(initial=0) <= 64 * n * np.finfo(float).eps * scale:
            return v, k
    return None


def components_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(13)
    vectors, values, waiting = np.empty_like(a), np.empty(len(a)), [(0, np.eye(len(a)), (a + a.T) / 2)]
    while waiting:
        at, basis, block = waiting.pop()
        split = divided(block, rng) if len(block) > 1 else None
        if split is None:
            vectors[:, at : at + len(block)] = basis
            values[at : at + len(block)] = np.diag(block)
            continue
        v, k = split
        for first, part in ((0, v[:, :k]), (k, v[:, k:])):
            inner = part.T @ block @ part
            waiting.append((at + first, basis @ part, (inner + inner.T) / 2))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- passes over the vectors -------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def on_lattice(vector: Column) -> Column:
    cut = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(cut(c) * SCALE) + F.lit(OFFSET).cast("long"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def summed(parts: DataFrame, dim: int) -> dict[int, list]:
    """Rows of matrices added up over tasks; integers as decimals, which do not overflow."""
    whole = dict(parts.dtypes)["v"] == "array<bigint>"
    totals = [F.sum(F.col("v")[j].cast("decimal(38,0)") if whole else F.col("v")[j]).alias(f"v{j}") for j in range(dim)]
    return {r[0]: [int(x) if whole else x for x in r[1:]] for r in parts.groupBy("i").agg(*totals).collect()}


def _rows_of(total: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    flat = pa.array(total.ravel(), kind)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], ["i", "v"])


def sums_of(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and sums by dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n += len(batch)
            total += matrix(batch.column(0), dim).sum(axis=0)
        if n:
            yield _rows_of(np.append(total, n)[None, :], pa.int64())

    found = summed(fit.select("x").mapInArrow(run, "i int, v array<bigint>"), dim + 1)
    return (found[0][dim], found[0][:dim]) if found else (0, [])


def product(y: np.ndarray) -> np.ndarray:
    """y' y for integers, exact: by doubles where no sum can pass 2^53, else by Python's integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < 1 << 53:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def covariance_of(fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, Fraction]:
    """Covariance over the fit list (divisor n), each entry rounded once, and its exact trace."""
    dim = len(sums)
    centre = np.array([_nearest(s, n) for s in sums], np.int64)
    limb = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for batch in batches:
            x = matrix(batch.column(0), dim) - centre
            for at in range(0, len(x), STRIPE):
                total += product(x[at : at + STRIPE])
        # Low parts in rows 0.., high parts in rows dim..: each fits a long.
        high = total // limb
        if total.any():
            yield _rows_of(np.vstack((total - high * limb, high)).astype(np.int64), pa.int64())

    parts = summed(fit.select("x").mapInArrow(run, "i int, v array<bigint>"), dim)
    moments = [[parts[i][j] + parts[dim + i][j] * limb if parts else 0 for j in range(dim)] for i in range(dim)]
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    exact = [[n * moments[i][j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
    return np.array([[e / (n * n) for e in row] for row in exact], float), Fraction(sum(exact[i][i] for i in range(dim)), n * n)


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


class Whitening:
    """The fitted map: number and sums of the fit list, eigenvalues, explained shares, components and their scaling."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, trace: Fraction, components: int) -> None:
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.k = min(components, self.dim)
        values, vectors = components_of(covariance)
        floor = self.dim * np.finfo(float).eps * max(values[0], 0.0)
        self.values, self.vectors = values[: self.k], vectors[:, : self.k]
        self.defined = self.values > floor
        self.explained = [float(v) / float(trace) if trace else None for v in self.values]
        self.scaled = self.vectors / np.sqrt(np.where(self.defined, self.values, 1.0))
        self.centre = np.array([_nearest(s, n) for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre)]
        self.offset = np.array([r / n for r in self.rest], float)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component, over the root of its eigenvalue."""
        return ((x - self.centre).astype(np.float64) - self.offset) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, exact; None beyond a long."""
        y = x - self.centre
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if largest <= isqrt(((1 << 63) - 1) // self.dim):
            d = y * self.n - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = y.astype(object) * self.n - np.array(self.rest, object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def identity_error(fit: DataFrame, fitted: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, over components with variance."""
    dim, k = fitted.dim, fitted.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        some = False
        for batch in batches:
            some = some or len(batch) > 0
            z = fitted.whiten(matrix(batch.column(0), dim))
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        if some:
            yield _rows_of(total, pa.float64())

    parts = summed(fit.select("x").mapInArrow(run, "i int, v array<double>"), k)
    moments, mean = np.array([parts[i] for i in range(k)]) / fitted.n, np.array(parts[k]) / fitted.n
    error = np.abs(moments - np.outer(mean, mean) - np.eye(k))[np.ix_(fitted.defined, fitted.defined)]
    return float(error.max()) if error.size else None


def lattice_rows(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """vec_id and x of the usable rows, and the length that most vectors have."""
    good = rows.select("vec_id", F.col(vector).alias("v")).where(usable(F.col("v")))
    length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = length.d if length else 0
    return good.where(F.size("v") == dim).select("vec_id", on_lattice(F.col("v")).alias("x")), dim


def fit_whitening(points: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The written fit list of distinct x, and the map fitted on it (None for an empty list)."""
    fit = materialize(points.select("x").distinct(), "fit-list")
    n, sums = sums_of(fit, dim) if dim else (0, [])
    if not n:
        return fit, None
    covariance, trace = covariance_of(fit, n, sums)
    return fit, Whitening(n, sums, covariance, trace, components)


def whiten_vectors(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays by component), identity_error of each usable row."""
    schema = "vec_id {}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    points, dim = lattice_rows(rows, vector)
    fit, fitted = fit_whitening(points, dim, components)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            z = fitted.whiten(x)
            gone = np.broadcast_to(~fitted.defined, z.shape)
            flat = pa.array(np.ascontiguousarray(z).ravel(), mask=np.ascontiguousarray(gone).ravel())
            ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fitted.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "whitened"]
            )

    mapped = points.mapInArrow(run, "vec_id {}, deviation long, whitened array<double>".format(rows.schema["vec_id"].dataType.simpleString()))
    shares = F.array(*(F.lit(x).cast("double") for x in fitted.explained))
    return mapped.select("vec_id", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", pairs.alias("place", "pair"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
