"""Whitening of vectors by their leading principal components.

Each entry ``c`` counts as the whole number ``floor(scale * c) + offset``.  One
pass over the table adds up these numbers, a second their products after the
rounded mean is taken off; both add whole numbers, so the sums are exact and the
same in every order.  What the rounding of the mean left out is put right
exactly on the sums: the covariance is that of centred values, rounded once.

The covariance has as many entries as the square of the dimension, whatever the
number of rows, and goes to the driver.  There it is made tridiagonal by
Householder reflections, the leading eigenvalues are found by bisection on Sturm
counts, and the components by inverse iteration, those of close eigenvalues
being made orthogonal to each other in each step.  The components, as many
numbers as ``k`` times the dimension, go to all tasks, which project the rows.

Rows whose vector is null, empty or holds a null or non-finite entry take no
part, and neither do vectors of another length than the most frequent one (of
ties the longest).  Numbers beyond ``LARGEST`` count as that.  A component whose
variance is zero within rounding has null ``whitened`` values and takes no part
in ``identity_error``, which is null if there is none.  ``deviation`` is null if
it doesn't fit a long.  Repeated rows each give their rows; without a row that
takes part there is no result.  Other columns are not read, so their names don't
clash.  Lineage is cut once, before the identity is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

SCALE, OFFSET = 1024, 100000
COMPONENTS = 8
# Entries are held between these bounds, in which doubles are exact.
LARGEST = 1 << 53
# Rows that are multiplied at once.
BLOCK = 4096
# Eigenvalues closer than this share of the largest one are of one cluster.
CLUSTER = 1e-3


def whole_numbers(vectors: pa.Array, dim: int, scale: int, offset: int) -> np.ndarray:
    """Rows of ``floor(scale * c) + offset``; the vectors are whole and of one length."""
    values = np.asarray(vectors.flatten()).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(scale * values) + offset, -LARGEST, LARGEST).astype(np.int64)


def _exact(block: np.ndarray, bound: int) -> np.ndarray:
    """The block as doubles if sums up to ``bound`` are exact in them, else as
    numbers of any size."""
    return block.astype(np.float64) if bound < LARGEST else block.astype(object)


def _partial_sums(dim: int, scale: int, offset: int):
    """Per task the sums of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            x = whole_numbers(batch.column(0), dim, scale, offset)
            for at in range(0, len(x), BLOCK):
                block = x[at:at + BLOCK]
                n += len(block)
                sums = _exact(block, int(np.abs(block).max()) * len(block)).sum(axis=0)
                total = [t + int(s) for t, s in zip(total, sums)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(-1, dim))), pa.array([n, *total], pa.decimal128(38, 0))], names=["i", "s"])
    return run


def _partial_products(dim: int, scale: int, offset: int, middle: list[int]):
    """Per task the sums of products of each pair of dimensions, the middle
    taken off before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        far = np.array(middle, np.int64)
        some = False
        for batch in batches:
            x = whole_numbers(batch.column(0), dim, scale, offset) - far
            for at in range(0, len(x), BLOCK):
                y = _exact(x[at:at + BLOCK], int(np.abs(x[at:at + BLOCK]).max()) ** 2 * BLOCK)
                product = y.T @ y
                total += product if y.dtype == object else product.astype(np.int64).astype(object)
                some = True
        if not some:
            return
        upper = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0] * dim + upper[1]), pa.array(total[upper].tolist(), pa.decimal128(38, 0))], names=["i", "s"])
    return run


def _added(df: DataFrame) -> dict[int, int]:
    got = df.groupBy("i").agg(F.sum("s").alias("s")).collect()
    return {r["i"]: int(r["s"]) for r in got}


def covariance(vectors: DataFrame, dim: int, scale: int, offset: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and covariance (divisor: the rows) of the only column of a table."""
    shape = "i bigint, s decimal(38,0)"
    sums = _added(vectors.mapInArrow(_partial_sums(dim, scale, offset), shape))
    n, total = sums[-1], [sums[i] for i in range(dim)]
    middle = [(2 * s + n) // (2 * n) for s in total]
    products = _added(vectors.mapInArrow(_partial_products(dim, scale, offset, middle), shape))
    rest = [s - n * m for s, m in zip(total, middle)]
    found = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            found[i, j] = found[j, i] = float(Fraction(n * products[i * dim + j] - rest[i] * rest[j], n * n))
    return n, total, found


def tridiagonal(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder
    reflections that make a symmetric matrix tridiagonal."""
    a = symmetric.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        part = a[k + 1:, k + 1:]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1:, k + 1:] = part - np.outer(v, w) - np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = x - 2 * (v @ x) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def smaller(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each ``x`` the Sturm count: how many eigenvalues are smaller."""
    tiny = np.finfo(float).tiny ** 0.5
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < tiny, np.copysign(tiny, q), q)
        q = diagonal[i] - x - beside[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, each
    halved in until no double lies between its bounds."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0], beside])) + np.abs(np.concatenate([beside, [0]]))
    slack = 1e-12 * (np.abs(diagonal) + reach).max() + np.finfo(float).tiny
    low = np.full(k, (diagonal - reach).min() - slack)
    high = np.full(k, (diagonal + reach).max() + slack)
    wanted = n - np.arange(k)
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = smaller(diagonal, beside, middle) >= wanted
        high = np.where(open_ & above, middle, high)
        low = np.where(open_ & ~above, middle, low)


def _solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """Solution of the shifted tridiagonal system, by elimination with row swaps."""
    n = len(diagonal)
    small = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0), np.finfo(float).tiny)
    d, y = (diagonal - shift).tolist(), b.tolist()
    first, second = [*beside.tolist(), 0.0], [0.0] * n
    for i in range(n - 1):
        under = float(beside[i])
        if abs(under) > abs(d[i]):
            d[i], under = under, d[i]
            first[i], d[i + 1] = d[i + 1], first[i]
            if i + 2 < n:
                second[i], first[i + 1] = first[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        d[i] = d[i] or small
        f = under / d[i]
        d[i + 1] -= f * first[i]
        first[i + 1] -= f * second[i]
        y[i + 1] -= f * y[i]
    for i in range(n - 1, -1, -1):
        y[i] -= (first[i] * y[i + 1] if i + 1 < n else 0.0) + (second[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] /= d[i] if abs(d[i]) > small else np.copysign(small, d[i])
    return np.array(y)


def leading_components(symmetric: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as rows.
    The entry of a vector that is largest without its sign is positive."""
    n = len(symmetric)
    # The largest entry becomes 1, so that no square overflows.
    unit = float(np.abs(symmetric).max())
    if not unit:
        return np.zeros(k), np.eye(k, n)
    diagonal, beside, mirrors = tridiagonal(symmetric / unit)
    values = leading_values(diagonal, beside, k)
    wide = max(abs(values[0]), np.finfo(float).tiny)
    random = np.random.default_rng(0)
    found: list[np.ndarray] = []
    start = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * wide:
            start = j
        # Equal eigenvalues get shifts that differ a little, so their solutions do.
        shift = value - 4 * np.finfo(float).eps * wide * (j - start)
        v = random.standard_normal(n)
        for _ in range(6):
            for other in found[start:j] * 2:
                v = v - (other @ v) * other
            v = _solved(diagonal, beside, shift, v / np.linalg.norm(v))
            v = v / np.abs(v).max()
        for other in found[start:j] * 2:
            v = v - (other @ v) * other
        found.append(v / np.linalg.norm(v))
    vectors = np.array(found).T
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i]
        vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    rows = vectors.T
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sign = np.sign(rows[np.arange(k), np.abs(rows).argmax(axis=1)])
    return values * unit, rows * sign[:, None]


def _projected(dim: int, scale: int, offset: int, n: int, total: list[int], rows: np.ndarray, share: list[float | None]):
    """Per vector its deviation and its whitened values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(total, object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = whole_numbers(part.column(1), dim, scale, offset)
                far = n * (int(np.abs(x).max()) + 1) + int(np.abs(sums).max())
                small = far < 1 << 62
                apart = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
                reach = int(np.abs(apart).max())
                square = apart if reach ** 2 * dim < 1 << 63 else apart.astype(object)
                deviation = [int(s) if s < 1 << 63 else None for s in (square * square).sum(axis=1)]
                whitened = (apart.astype(np.float64) / n) @ rows.T
                lists = [[None if s is None else w for w, s in zip(row, share)] for row in whitened.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(deviation, pa.int64()), pa.array(lists, pa.list_(pa.float64()))],
                    names=["id", "deviation", "whitened"])
    return run


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, component`` (from 1)``, n, deviation, whitened, explained,
    identity_error``: each vector that takes part, projected on the leading
    components and divided by the roots of their variances."""
    spark = df.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = df.where(F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, number), F.lit(False))).select(
        F.col(f"`{vec_id}`").alias("id"), v.alias("v"))
    kind = dict(df.dtypes)[vec_id]
    out = (f"{vec_id} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double")
    sizes = whole.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], out)
    dim = usual["size"]
    whole = whole.where(F.size("v") == dim)
    n, total, found = covariance(whole.select("v"), dim, scale, offset)
    k = min(k, dim)
    values, rows = leading_components(found, k)
    trace = float(np.trace(found))
    real = values > dim * np.finfo(float).eps * max(trace, 0.0)
    rows = rows / np.sqrt(np.where(real, values, 1.0))[:, None]
    explained = [float(e / trace) if ok else 0.0 for e, ok in zip(values, real)]
    share = [e if ok else None for e, ok in zip(explained, real)]
    narrow = Scratch(spark, "whitening").keep(
        whole.mapInArrow(_projected(dim, scale, offset, n, total, rows, share),
                         f"id {kind}, deviation bigint, whitened array<double>"), "whitened")
    error = identity_error(narrow, [i for i in range(k) if real[i]])
    each = narrow.select(F.col("id").alias(vec_id), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained])
    return each.select(vec_id, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"),
                       "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"))


def identity_error(narrow: DataFrame, components: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the whitened values less
    the identity; two passes, the second over centred values."""
    if not components:
        return None
    value = [F.col("whitened")[i] for i in components]
    means = narrow.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    centred = [v - F.lit(means[i]) for i, v in enumerate(value)]
    pairs = [(i, j) for i in range(len(value)) for j in range(i, len(value))]
    got = narrow.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
