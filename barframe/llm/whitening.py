"""Whitening of embedding vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries become whole numbers x = floor(64 c) + 1000000. Three passes over the vectors fit a model: the sums of each
dimension (exact), the covariance of the centred x (every task adds up its own and sends d rows of d numbers, which
are added per entry), and the covariance of the whitened vectors, which must be the identity.
On the driver is only that d x d matrix V. Its pivoted Cholesky factor L (V = L L') is a triangle with
permuted rows. One-sided Jacobi turns pairs of columns of L until all are orthogonal; the columns' norms squared
are then the eigenvalues of V, and the columns divided by their norms the components. V itself is
never iterated on, so small eigenvalues keep their digits.

Left out are vectors that are null or empty, hold null or non-finite entries, or entries of 2^30 or more; and
vectors of another length than most have (of two lengths as frequent, the longer counts). Repeated rows and null
ids count as rows like others. A deviation that exceeds a long is null. Directions without variance have no
component, so a table of equal vectors, like an empty one, gives no rows. Vectors of more than max_dims dimensions
raise an error. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
MOST = float(2**30)
MAX_DIMS = 2048
SWEEPS = 60
ROWS = 4096

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Whitening:
    """centre and rest: per dimension, sum = n * centre + rest with 0 <= rest < n. components: one column each."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) - self.rest / self.n

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        return self.centred(x) @ (self.components[:, :most] / np.sqrt(self.eigenvalues[:most]))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n x - sum)^2, exact; as Python's whole numbers where a long may not hold it."""
        if (self.n * np.abs(self.centred(x)).max(initial=0.0)) ** 2 * x.shape[1] < 2.0**62:
            return ((self.n * (x - self.centre) - self.rest) ** 2).sum(axis=1)
        wide = self.n * (x - self.centre).astype(object) - self.rest.astype(object)
        return (wide * wide).sum(axis=1)


def _numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, x): the vectors that count, as whole numbers."""
    fine = F.forall(vector_col, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) < MOST, F.lit(False)))
    kept = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fine)
    most = kept.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = most.orderBy(F.desc("n"), F.desc("d")).first()
    return kept.where(F.size(vector_col) == (most["d"] if most else 0)).select(
        F.col(id_col).alias("id"), _numbers(F.col(vector_col)).alias("x")
    )


def _matrices(batches: Batches, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            yield batch, batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _added(x: DataFrame, part) -> dict[int, float]:
    """Sums over all tasks of what part makes of a matrix of rows: a flat array, the same length for all."""

    def run(batches: Batches) -> Batches:
        total = None
        for _, rows in _matrices(batches, 0):
            total = part(rows) if total is None else total + part(rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    kind = "long" if part is _sums else "double"
    found = x.select("x").mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v"))
    return {r["k"]: r["v"] for r in found.collect()}


def _sums(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(rows)], rows.sum(axis=0)]).astype(np.int64)


def cholesky(v: np.ndarray) -> np.ndarray:
    """L with L L' = v and as many columns as v has rank; rows in v's order, columns in that of the pivots."""
    d = len(v)
    left, at_least = v.diagonal().astype(float), np.finfo(float).eps * d * max(np.trace(v), 0.0)
    columns: list[np.ndarray] = []
    for _ in range(d):
        pivot = int(np.argmax(left))
        if left[pivot] <= at_least:
            break
        column = v[:, pivot] - sum((c * c[pivot] for c in columns), np.zeros(d))
        column = column / np.sqrt(left[pivot])
        column[left == 0] = 0.0
        left = np.maximum(left - column**2, 0.0)
        left[pivot] = 0.0
        columns.append(column)
    return np.array(columns).reshape(-1, d).T


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit components (columns) of factor factor'."""
    a = factor.copy()
    r = a.shape[1]
    seats = list(range(r)) + ([-1] if r % 2 else [])
    half = len(seats) // 2
    for _ in range(SWEEPS):
        turned = 0.0
        for _ in range(len(seats) - 1):  # a round-robin: every pair of columns meets once, disjoint pairs at a time
            pairs = [(p, q) for p, q in zip(seats[:half], reversed(seats[half:])) if p >= 0 and q >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.maximum(np.sqrt(xx * yy), np.finfo(float).tiny)
            turned = max(turned, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-16
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1.0 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if turned < 1e-14:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


def learn(x: DataFrame, max_dims: int = MAX_DIMS) -> Whitening | None:
    """The model of all rows of usable(); None if there are none or all are equal."""
    totals = _added(x, _sums)
    n, d = totals.get(0, 0), len(totals) - 1
    if not n:
        return None
    if d > max_dims:
        raise ValueError(f"{d} dimensions, at most {max_dims} are taken")
    split = [divmod(totals[k + 1], n) for k in range(d)]
    bare = Whitening(n, np.array([c for c, _ in split]), np.array([r for _, r in split]), np.empty(0), np.empty((d, 0)), 0.0)

    def scatter(rows: np.ndarray) -> np.ndarray:
        y = bare.centred(rows)
        return (y.T @ y).ravel()

    sums = _added(x, scatter)
    v = np.array([sums[k] for k in range(d * d)]).reshape(d, d) / n
    eigenvalues, components = jacobi(cholesky((v + v.T) / 2))
    if not len(eigenvalues):
        return None
    return Whitening(n, bare.centre, bare.rest, eigenvalues, components, float(np.trace(v)))


def identity_error(x: DataFrame, model: Whitening, most: int) -> float:
    """The largest entry, without sign, of the whitened vectors' covariance minus the identity.

    The vectors are centred by exact sums before they are projected, so the whitened ones have mean 0.
    """
    k = min(most, len(model.eigenvalues))

    def scatter(rows: np.ndarray) -> np.ndarray:
        w = model.whitened(rows, most)
        return (w.T @ w).ravel()

    sums = _added(x, scatter)
    covariance = np.array([sums[i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each vector that counts and
    each of the first `most` components."""
    x = usable(vectors, id_col, vector_col)
    schema = T.StructType(
        [
            T.StructField("id", x.schema["id"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    model = learn(x)
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    error = identity_error(x, model, most)
    explained = model.eigenvalues[:most] / model.trace
    k = len(explained)

    def run(batches: Batches) -> Batches:
        for batch, rows in _matrices(batches, 1):
            m = len(rows)
            deviations = [int(v) if v < 2**63 else None for v in model.deviations(rows)]
            each = pa.array(np.repeat(np.arange(m), k))
            arrays = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(deviations, pa.int64()).take(each),
                pa.array(model.whitened(rows, most).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return x.mapInArrow(run, schema)
