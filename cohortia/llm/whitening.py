"""Whitening of embeddings by their leading principal components.

Vectors become integers, x = floor(scale * entry) + shift. One pass sums them exactly; a second sums
the products of what is left after subtracting the rounded means, so centring comes before
multiplying and the sums are those of small integers; the rest of the centring is a correction
with the exact remainders. Tasks add up their own rows, and two rounds of grouping add up the tasks.

The covariance, which is as large as the dimensions allow and no larger for more rows, is brought to
tridiagonal form by Householder reflections on the driver. Bisection on Sturm counts finds
its leading eigenvalues, inverse iteration the vectors, made orthogonal to those of near
eigenvalues in every step; the reflections carry them back. The components are sent to all tasks,
which project the rows; a last pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: The covariance of so many dimensions is 128 MB; more are refused.
MAX_DIMENSIONS = 4096
#: Partial sums meet in so many groups before they meet in one.
GROUPS = 1024
#: Rows of a vector block.
BLOCK_ROWS = 4096
EPS = float(np.finfo(float).eps)


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of the tridiagonal form of a symmetric matrix, and the unit reflectors.

    Reflector k acts on coordinates k + 1 onwards.
    """
    a = np.array(matrix, float)
    n = len(a)
    off, reflectors = np.zeros(max(0, n - 1)), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        size = np.linalg.norm(v)
        if not np.linalg.norm(x[1:]) > 0 or size == 0:  # nothing to clear
            reflectors.append(np.zeros_like(x))
            off[k] = x[0]
            continue
        v /= size
        reflectors.append(v)
        off[k] = -np.copysign(length, x[0])
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
    if n > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off, reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point."""
    least = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0.0)))
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - e * e / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues in falling order, each bisected to neighbouring numbers."""
    n = len(diagonal)
    reach = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    span = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(float).tiny)
    lo, hi = np.full(count, -span * (1 + 4 * EPS * n)), np.full(count, span * (1 + 4 * EPS * n))
    wanted = n - np.arange(count)  # so many eigenvalues do not exceed the k-th largest
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if not np.any((lo < mid) & (mid < hi)):
            break
        under = sturm_counts(diagonal, off, mid) >= wanted
        hi, lo = np.where(under, mid, hi), np.where(under, lo, mid)
    return lo + (hi - lo) / 2


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; a vanishing pivot counts as ``least``."""
    n = len(diagonal)
    main, beside, b = (diagonal - shift).tolist(), [*off.tolist(), 0.0], right.tolist()
    rows = []
    now = (main[0], beside[0], 0.0)
    for k in range(n - 1):
        below = (beside[k], main[k + 1], beside[k + 1])
        if abs(below[0]) > abs(now[0]):
            now, below = below, now
            b[k], b[k + 1] = b[k + 1], b[k]
        pivot = now[0] if abs(now[0]) > least else least
        rows.append((pivot, now[1], now[2]))
        m = below[0] / pivot
        b[k + 1] -= m * b[k]
        now = (below[1] - m * now[1], below[2] - m * now[2], 0.0)
    rows.append((now[0] if abs(now[0]) > least else least, 0.0, 0.0))
    x = [0.0] * (n + 2)
    for k in range(n - 1, -1, -1):
        pivot, one, two = rows[k]
        x[k] = (b[k] - one * x[k + 1] - two * x[k + 2]) / pivot
    return np.array(x[:n])


def _inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for its eigenvalues in falling order."""
    n = len(diagonal)
    size = float(np.max(np.abs(diagonal), initial=0.0) + 2 * np.max(np.abs(off), initial=0.0))
    least, near = EPS * size, 1e-3 * size
    out = np.zeros((n, len(values)))
    seeds = np.random.default_rng(17)
    first = 0  # of the cluster of near eigenvalues
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > near:
            first = k
        # Equal eigenvalues are moved apart by a few units in the last place, else every start leads to one vector.
        shift = min(float(value), shift - 10 * EPS * size) if k > first else float(value)
        cluster = out[:, first:k]
        x = seeds.standard_normal(n)
        for turn in range(40):
            x -= cluster @ (cluster.T @ x)
            x /= np.linalg.norm(x)
            y = _solve_shifted(diagonal, off, shift, x, least)
            y /= np.max(np.abs(y))
            for _ in range(2):
                y -= cluster @ (cluster.T @ y)
            y /= np.linalg.norm(y)
            still = min(np.linalg.norm(y - x), np.linalg.norm(y + x))
            x = y
            if turn and still < 8 * EPS * np.sqrt(n):
                break
        out[:, k] = x
    return out


def leading_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    The largest entry of a vector is positive. Eigenvalues that rounding cannot tell from 0 are left out.
    """
    n = len(covariance)
    scale = float(np.max(np.abs(covariance), initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    matrix = covariance / scale
    diagonal, off, reflectors = householder(matrix)
    values = leading_eigenvalues(diagonal, off, min(count, n))
    values = values[values > 16 * n * EPS * values[0]]
    vectors = _inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    rest = np.max(np.linalg.norm(matrix @ vectors - vectors * values, axis=0), initial=0.0)
    slant = np.max(np.abs(vectors.T @ vectors - np.eye(len(values))), initial=0.0)
    if rest > 1e-10 * values[0] or slant > 1e-10:
        raise ArithmeticError(f"inverse iteration did not settle: residual {rest:.1e}, orthogonality {slant:.1e}")
    vectors *= np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return values * scale, vectors


class Whitening(NamedTuple):
    """Fitted components: n rows of exact sums (``sums``), eigenvalues, unit vectors, trace, and the shift and scale of entries."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int


def usable(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows whose vector is there, not empty, and of finite entries that fit a long once scaled."""
    v = F.col(vector)
    fits = lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= F.lit(float(1 << 52) / scale))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fits))


def _blocks(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray]]:
    """The integers of a batch's vectors, a few thousand rows at a time, and the first row of each."""
    vectors = batch.column("v")
    for a in range(0, batch.num_rows, BLOCK_ROWS):
        flat = vectors.slice(a, BLOCK_ROWS).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = min(BLOCK_ROWS, batch.num_rows - a)
        yield a, np.floor(flat * scale).astype(np.int64).reshape(rows, -1) + shift


def _summed(partial: DataFrame, kind: str) -> list:
    """Rows (i, sums) of all tasks added up by i in two rounds; in ascending i."""
    schema = f"i int, sums array<{kind}>"

    def add(table: pa.Table) -> pa.Table:
        column = table.column("sums").combine_chunks()
        total = column.flatten().to_numpy().reshape(len(column), -1).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([total], column.type)})

    some = partial.withColumn("g", F.spark_partition_id() % GROUPS).groupBy("i", "g").applyInArrow(add, schema)
    return some.groupBy("i").applyInArrow(add, schema).orderBy("i").collect()


def _per_task(of_block: Callable[[np.ndarray], np.ndarray], width: int, kind: str, scale: int, shift: int):
    """Each task's sum of what ``of_block`` makes of its blocks: a matrix of ``width`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch, scale, shift):
                part = of_block(x)
                total = part if total is None else total + part
        if total is not None:
            t = pa.list_(pa.int64() if kind == "long" else pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), t)], ["i", "sums"])

    return run


def fit(rows: DataFrame, vector: str = "embedding", count: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Components of all usable vectors of the commonest length (of equal ones the longest); None without any."""
    given = usable(rows, vector, scale)
    lengths = given.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["n"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the covariance of more than {MAX_DIMENSIONS} does not fit the driver")
    vectors = given.where(F.size(vector) == d).select(F.col(vector).alias("v"))
    sums = vectors.mapInArrow(_per_task(lambda x: x.sum(axis=0)[None, :], 1, "long", scale, shift), "i int, sums array<long>")
    sums = [int(s) for s in _summed(sums, "long")[0]["sums"]]
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the means, rounded
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    centre = np.array(middle, np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(np.float64)
        return y.T @ y

    total = vectors.mapInArrow(_per_task(products, d, "double", scale, shift), "i int, sums array<double>")
    total = np.array([r["sums"] for r in _summed(total, "double")])
    covariance = total / n - np.outer(rest, rest)
    covariance = (covariance + covariance.T) / 2
    values, found = leading_components(covariance, count)
    return Whitening(n, sums, values, found, float(np.trace(covariance)), scale, shift)


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    middle = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    centre = np.array(middle, np.int64)
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, middle)])
    weights = model.vectors / np.sqrt(model.values)
    return lambda x: ((x - centre) - rest) @ weights


def _deviations(model: Whitening) -> Callable[[np.ndarray], list[int | None]]:
    """Per row the exact sum over dimensions of (n x - S)^2; None if it does not fit a long."""
    n = model.n
    middle = [(2 * s + n) // (2 * n) for s in model.sums]
    centre, rest = np.array(middle, np.int64), [s - n * m for s, m in zip(model.sums, middle)]

    def of(x: np.ndarray) -> list[int | None]:
        y = x - centre
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * y.shape[1] < 1 << 62:
            return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    return of


def measured_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    k = len(model.values)
    if not k:
        return 0.0
    project = _projection(model)

    def moments(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)[None, :]])

    vectors = usable(rows, vector, model.scale).where(F.size(vector) == len(model.sums)).select(F.col(vector).alias("v"))
    partial = vectors.mapInArrow(_per_task(moments, k + 1, "double", model.scale, model.shift), "i int, sums array<double>")
    total = np.array([r["sums"] for r in _summed(partial, "double")]) / model.n
    return float(np.max(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k))))


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every usable row and component.

    A row is left out if its vector is null, empty, holds a null, a number that is not finite or one beyond 2^52 / scale,
    or has another length than the vectors fitted. Components whose variance rounding cannot tell from 0 do not exist, so equal
    vectors, or one row, give an empty result. Repeated rows and null keys each come back; ``deviation`` is null where the exact
    sum does not fit a long. Other columns are left out, so their names cannot clash.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    k, n, error = len(model.values), model.n, measured_error(rows, model, vector)
    project, deviations = _projection(model), _deviations(model)
    explained = model.values / model.trace
    scale, shift = model.scale, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in _blocks(batch, scale, shift):
                m = len(x)
                named = batch.column("key").slice(a, m).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [named, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation]
                columns += [pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    given = usable(rows, vector, scale).where(F.size(vector) == len(model.sums))
    return given.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(run, schema)
