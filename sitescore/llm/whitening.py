"""Embedding whitening: means and covariance by Welford's updates, components by symmetric QR.

Each partition streams through its vectors with rank-one updates of a mean and a matrix of products;
the partitions' states are merged by the parallel update formula, in rounds of tasks until one is
left. The covariance is brought to tridiagonal form by reflections and diagonalised by implicitly
shifted QR steps. Entries are quantised to whole numbers first, so sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Whole numbers that doubles hold exactly; greater entries are cut to this.
EXACT = 1 << 53
#: A task merges about so many states, each of the square of the dimension; one reaches the driver.
FAN_IN = 32
STATE = "n long, sums array<long>, mean binary, products binary"
SCHEMA = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.binary()), ("products", pa.binary())])


@dataclass
class Moments:
    """n vectors: exact sums of their whole numbers, mean, and sums of products of deviations."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Moments:
        return cls(0, np.zeros(size, object), np.zeros(size), np.zeros((size, size)))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one vector."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        self.products += np.multiply.outer(off, x - self.mean)

    def merge(self, other: Moments) -> Moments:
        """The moments of both lists of vectors, by the parallel update formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        products = self.products + other.products + np.multiply.outer(off, off) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + off * (other.n / n), products)

    def covariance(self) -> np.ndarray:
        """With divisor n, made symmetric."""
        return (self.products + self.products.T) / (2 * max(1, self.n))

    def row(self) -> tuple:
        return self.n, [int(s) for s in self.sums], self.mean.tobytes(), self.products.tobytes()


def moments_of(n: int, sums: list[int], mean: bytes, products: bytes) -> Moments:
    mean = np.frombuffer(mean)
    return Moments(n, np.array(sums, object), mean.copy(), np.frombuffer(products).reshape(len(mean), -1).copy())


def usable(vector: Column) -> Column:
    """Neither null nor empty, all entries finite."""
    fine = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def quantised(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """A batch's vectors, a row each, as floor(64 c); OFFSET is left to the callers, which keeps rounding small."""
    vectors = batch.column(column)
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.clip(np.floor(SCALE * values), -EXACT, EXACT)


def packed(state: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, state.row(), strict=True))] * (state.n > 0), SCHEMA)


def gathered(vectors: DataFrame, size: int, project: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """The moments of all rows of vectors(vector), or of what project() makes of matrices of them, which has no sums."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(size)
        for batch in batches:
            if batch.num_rows:
                x = quantised(batch, 0)
                if project is None:
                    state.sums = state.sums + x.astype(np.int64).sum(0)
                for row in x if project is None else project(x):
                    state.add(row)
        yield packed(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(size)
        for batch in batches:
            for r in batch.to_pylist():
                state = state.merge(moments_of(**r))
        yield packed(state)

    states = checkpoint(vectors.select("vector").mapInArrow(stream, STATE))
    n = states.count()
    while n > 1:
        n = -(-n // FAN_IN)
        states = checkpoint(states.repartition(n).mapInArrow(merge, STATE))
    found = states.first()
    return moments_of(*found) if found else Moments.empty(size)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q' a q tridiagonal, by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale == 0:
            continue
        v /= scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, by implicit QR steps with
    Wilkinson's shift on its tridiagonal form."""
    d, e, q = tridiagonal(a)
    high, left = len(d) - 1, 60 * len(d)
    least = np.finfo(float).eps * max([0.0, *np.abs(d), *np.abs(e)])
    while high > 0:
        e[:high][np.abs(e[:high]) <= least] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        cuts = np.flatnonzero(e[:high] == 0)
        low = cuts[-1] + 1 if len(cuts) else 0
        left -= 1
        if left < 0:
            raise ArithmeticError("the QR steps don't converge")
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            top, bottom, side = d[k], d[k + 1], e[k]
            d[k] = c * c * top + 2 * c * s * side + s * s * bottom
            d[k + 1] = s * s * top - 2 * c * s * side + c * c * bottom
            e[k] = c * s * (bottom - top) + (c * c - s * s) * side
            x = e[k]
            if k + 1 < high:
                z = s * e[k + 1]
                e[k + 1] *= c
            q[:, [k, k + 1]] = q[:, [k, k + 1]] @ np.array([[c, -s], [s, c]])
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Whitening:
    """A fitted transform of whole-number vectors (without OFFSET)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x."""
        n = self.n
        whole = np.array([int(s) // n for s in self.sums], float)
        rest = np.array([int(s) % n / n for s in self.sums])
        return ((x - whole) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the exact sum of (n x - S)^2."""
        if not len(x):
            return []
        sums, most = self.sums, np.abs(x).max(0)
        bound = max((self.n * int(m) + abs(int(s)) for m, s in zip(most, sums, strict=True)), default=0)
        if bound**2 * len(sums) < 1 << 63:
            off = self.n * x.astype(np.int64) - sums.astype(np.int64)
            return (off * off).sum(1).tolist()
        return [sum((self.n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]


def vectors_of(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id, vector) of the usable vectors as doubles, and their length: the commonest one, of several the greatest."""
    own = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    most = own.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    return own.where(F.size("vector") == size), size


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The transform to the first components of vectors(vec_id, vector), all of one size.

    Components whose eigenvalue is zero but for rounding are left out, as nothing can be divided by its root. The
    identity error is that of the whitened vectors themselves, read once more.
    """
    if not size:
        return Whitening(0, np.zeros(0, object), np.zeros(0), np.zeros((0, 0)), 0.0)
    found = gathered(vectors, size)
    covariance = found.covariance()
    values, columns = symmetric_qr(covariance)
    own = values[:components] > max(0.0, values[0]) * size * np.finfo(float).eps
    n = int(own.sum())
    model = Whitening(found.n, found.sums, values[:n], columns[:, :n], float(np.trace(covariance)))
    if n:
        model.identity_error = float(np.abs(gathered(vectors, n, model.project).covariance() - np.eye(n)).max())
    return model


def transformed(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) for each row and component."""
    k, shared = len(model.values), vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x, rows = quantised(batch, 1), batch.num_rows
            deviation = pa.array([d if d < 1 << 63 else None for d in m.deviations(x)], pa.int64())
            each = np.repeat(np.arange(rows), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, m.n, np.int64)),
                deviation.take(pa.array(each)),
                pa.array(m.project(x).ravel()),
                pa.array(np.tile(m.values / m.trace, rows)),
                pa.array(np.full(rows * k, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """The rows of transformed() for table(vec_id, vector, ...), fitted on all its usable vectors.

    Vectors that are null or empty, or hold a null or an entry that isn't finite, are dropped, as are those of
    another length than the commonest. Entry c becomes floor(64 c) + 1,000,000 (the offset cancels out everywhere). A
    deviation beyond a long is null. Null and repeated ids stay as they are. Tied eigenvalues have any orthogonal
    vectors of theirs, the same for all rows. An empty table, or one without any spread, gives no rows; other
    columns are ignored. Vectors of any length are read whole; a state has the square of it.
    """
    vectors, size = vectors_of(table, vector, vec_id)
    return transformed(vectors, fit(vectors, size, components))
