"""Embedding whitening: the leading components of all distinct vectors, by contour integration.

Vectors are taken on a grid of 1/256 as whole numbers ``x``; each distinct one counts once. Their number, exact sums and
the covariance, centred before multiplying, are partial sums per task, added up in two steps, so the driver
receives one table of ``d * d`` numbers for ``d`` dimensions, however many rows there are.

On it, the FEAST method finds the largest eigenvalues. The interval is chosen by inertia counts: the signs of the pivots
of a symmetric factorisation of ``V - a I`` tell how many eigenvalues lie above ``a``. A Gauss-Legendre rule on a circle around
the interval sums complex solves ``(z I - V) Q = Y``, which projects a block of vectors onto the eigenvectors inside;
Rayleigh-Ritz extracts them, and the step is repeated on what it finds. It has found all if as many Ritz values
with small residuals lie in the interval as the inertia counts say; else the block grows, up to ``d`` columns.

Rows whose vector is null or empty, or holds null or non-finite entries, go, and so do those whose length is not the most
frequent one (the larger one, if two are); repeated rows stay and are all whitened; ids are only handed through. Without any
spread (no row, or a single distinct vector) there is no component and so no row; directions whose variance is zero
to double precision are no components. Other columns are left out, whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import batch_of, tree_sum, written

SCALE = 256
COMPONENTS = 4
NODES = 8            # of the quadrature on the half circle
SPARE = 4            # columns beyond the expected number of eigenvalues
ROUNDS = 40
EPS = float(np.finfo(float).eps)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(_id, x array<long>)`` of the rows that count."""
    finite = F.forall("_v", lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))
    rows = (df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
            .where(F.size("_v") > 0).where(finite))
    lengths = rows.groupBy(F.size("_v").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("_v") == (most.d if most else 0)).select(
        "_id", F.transform("_v", lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(fitted: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension, which are added up in halves of 32 bits."""
    def measure(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            yield np.concatenate(([len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)))

    total = tree_sum(fitted, measure, np.int64)
    if total is None:
        return 0, []
    d = len(total) // 2
    return int(total[0]), [(int(h) << 32) + int(s) for h, s in zip(total[1:d + 1], total[d + 1:])]


def covariance(fitted: DataFrame, n: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Of the vectors, or of what ``project`` makes of the centred ones."""
    def measure(batches):
        for batch in batches:
            y = matrix(batch.column(0)) - mean
            y = y if project is None else y @ project
            yield np.concatenate((y.sum(0), (y.T @ y).ravel()))

    total = tree_sum(fitted, measure, np.float64) / n
    k = len(mean) if project is None else project.shape[1]
    return total[k:].reshape(k, k) - np.outer(total[:k], total[:k])  # the mean of centred values: rounding only


def count_above(v: np.ndarray, a: float) -> int:
    """Eigenvalues of a symmetric matrix above ``a``: positive pivots of a factorisation with full pivoting, where a
    pivot of two rows has one positive and one negative eigenvalue."""
    m, above = v - a * np.eye(len(v)), 0
    while len(m):
        size = np.abs(m)
        on = size.diagonal().copy()
        np.fill_diagonal(size, 0)
        r = int(on.argmax())
        s, t = divmod(int(size.argmax()), len(m))
        if on[r] == 0 and size[s, t] == 0:
            break
        pivot = [r] if on[r] >= 0.64 * size[s, t] else [s, t]
        above += 1 if len(pivot) == 2 else int(m[r, r] > 0)
        rest = np.setdiff1d(np.arange(len(m)), pivot)
        side = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(pivot, pivot)], side.T)
        m = (m + m.T) / 2
    return above


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and vectors of a block's span."""
    q = np.linalg.qr(block)[0]
    small = q.T @ v @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], q @ turn[:, ::-1]


def project(v: np.ndarray, block: np.ndarray, a: float, b: float) -> np.ndarray:
    """Quadrature of the contour integral of the resolvent around ``[a, b]``, applied to a block."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = (b - a) / 2 * np.exp(0.5j * np.pi * (1 + nodes))
    total = np.zeros_like(block)
    for w, t in zip(weights, turn):
        total += w / 2 * (t * np.linalg.solve(((a + b) / 2 + t) * np.eye(len(v)) - v, block)).real
    return total


def interval(v: np.ndarray, k: int, low: float, high: float, start: np.ndarray) -> tuple[float, int]:
    """``(a, m)``: ``m`` eigenvalues lie above ``a``, ``k`` of them or a few more."""
    block = start
    for _ in range(20):
        values, block = ritz(v, v @ block)
    a = float(values[k - 1] + values[k]) / 2 if k < len(values) else low
    while True:
        a = min(max(a, low), high)
        m = count_above(v, a)
        if k <= m <= k + SPARE // 2 or high - low <= 1e-12 * high:
            return (a, m) if m >= k else (low, count_above(v, low))
        low, high = (a, high) if m > k else (low, a)
        a = (low + high) / 2


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above zero, falling, and their unit vectors as columns, the entry of largest size
    positive."""
    d, zero = len(v), max(len(v), 16) * EPS * float(np.trace(v))
    k = min(k, count_above(v, zero)) if zero > 0 else 0
    if not k:
        return np.zeros(0), np.zeros((d, 0))
    bound = float(np.abs(v).sum(1).max()) * 1.01
    rng = np.random.Generator(np.random.PCG64(11))
    width = min(d, k + SPARE)
    a, m = interval(v, k, zero, bound, rng.standard_normal((d, width)))
    width = min(d, max(width, m + SPARE))
    while True:
        block = rng.standard_normal((d, width))
        for _ in range(ROUNDS):
            values, block = ritz(v, project(v, block, a, bound))
            inside = (values > a) & (values < bound)
            missed = np.linalg.norm(v @ block - block * values, axis=0)[inside]
            if inside.sum() == m and missed.max() <= zero:
                break
        if inside.sum() == m or width == d:
            break
        width = min(d, 2 * width)
    if width == d and inside.sum() != m:  # a whole basis: Rayleigh-Ritz without a contour
        values, block = ritz(v, np.eye(d))
    vectors = block[:, :k]
    return values[:k], vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of each usable row and component: ``n``
    distinct vectors, ``deviation`` the sum of ``(n * x - S) ** 2`` (null where it exceeds a long)."""
    rows = usable(df, id_col, vector_col)
    out = pa.schema([(id_col, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    schema = (f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    fitted = written(rows.select("x").distinct(), "vectors")
    n, sums = exact_sums(fitted)
    mean = np.array([s / n for s in sums])
    v = covariance(fitted, n, mean) if n else np.zeros((0, 0))
    values, vectors = leading(v, k)
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    turn, share = vectors / np.sqrt(values), values / np.trace(v)
    error = float(np.abs(covariance(fitted, n, mean, turn) - np.eye(len(values))).max())

    def deviations(x: np.ndarray) -> list:
        reach = max(n * max(abs(int(x.min())), abs(int(x.max()))), max(map(abs, sums)))
        if 4 * x.shape[1] * reach * reach < 1 << 63:
            return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, of = matrix(batch.column(1)), len(values)
                each = np.repeat(np.arange(batch.num_rows), of)
                yield batch_of(out, [
                    batch.column(0).take(pa.array(each)), np.tile(np.arange(1, of + 1, dtype=np.int32), len(x)),
                    np.full(len(each), n), pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                    ((x - mean) @ turn).ravel(), np.tile(share, len(x)), np.full(len(each), error)])

    return rows.mapInArrow(run, schema)
