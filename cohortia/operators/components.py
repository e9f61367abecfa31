"""Leading principal components of rows with any number of dimensions, dense or sparse.

A block Krylov method: each step multiplies the covariance with a few columns in one pass over the
rows and adds the result to a basis, in which the components are read off; it ends when no
component leaves a residual. What the driver holds is dimensions x columns, never dimensions x
dimensions. Rows are not centred in storage: an absent cell of a sparse row has a value of its
own per dimension, and the means are subtracted inside the products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators.batched import NotConverged

#: Columns beyond those asked for, and blocks before the basis is condensed to its best columns.
SPARE, MAX_BLOCKS = 10, 12
#: Cells, or given cells times columns, that a task works on at once.
BLOCK_CELLS = 1 << 20
DIRECT_BYTES, CHUNK = 64 << 20, 1 << 16


@dataclass(frozen=True)
class Rows:
    """Rows as (sample_id, vec), or as (sample_id, idx, val) where a cell is base + val if given and base else; ``shift`` is taken off."""

    table: DataFrame
    dimensions: int
    shift: np.ndarray
    base: np.ndarray | None = None

    @property
    def columns(self) -> list[str]:
        return ["vec"] if self.base is None else ["idx", "val"]


def _products(rows: Rows) -> Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[int, np.ndarray, Callable[[np.ndarray], np.ndarray], float]]]:
    """Per block of a batch: first row, the rows times ``q``, how to multiply their transpose, and their sum of squares."""
    d, sparse = rows.dimensions, rows.base is not None
    offset = (rows.base - rows.shift) if sparse else -rows.shift

    def dense(batch: pa.RecordBatch, q: np.ndarray):
        step = max(1, BLOCK_CELLS // d)
        for a in range(0, batch.num_rows, step):
            part = batch.column("vec").slice(a, step)
            x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d) + offset
            yield a, x @ q, lambda z, x=x: x.T @ z, float((x * x).sum())

    def by_cell(batch: pa.RecordBatch, q: np.ndarray):
        idx, val = batch.column("idx"), batch.column("val")
        sizes = idx.value_lengths().to_numpy(zero_copy_only=False)
        flat, values = idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(sizes)])
        most, plain, whole = max(1, BLOCK_CELLS // q.shape[1]), offset @ q, float(offset @ offset)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1)
            at, v = flat[first[a] : first[b]], values[first[a] : first[b]]
            row = np.repeat(np.arange(b - a), sizes[a:b])
            xq = np.tile(plain, (b - a, 1))
            np.add.at(xq, row, v[:, None] * q[at])

            def back(z: np.ndarray, at=at, v=v, row=row) -> np.ndarray:
                out = np.outer(offset, z.sum(axis=0))
                order = np.argsort(at, kind="stable")
                if len(order):
                    start = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
                    out[at[order][start]] += np.add.reduceat((v[:, None] * z[row])[order], start, axis=0)
                return out

            yield a, xq, back, (b - a) * whole + float((v * v + 2 * v * offset[at]).sum())
            a = b

    return by_cell if sparse else dense


class Covariance:
    """The covariance (divisor n) of rows as an operator on columns."""

    def __init__(self, rows: Rows):
        self.rows, self.table = rows, rows.table.select(*rows.columns).persist()
        self.n = self.table.count()
        self.tasks = self.table.select(F.spark_partition_id().alias("p")).distinct().count()
        self.passes, self.trace = 0, 0.0

    def close(self) -> None:
        self.table.unpersist()

    def times(self, q: np.ndarray) -> np.ndarray:
        """covariance @ q, in one pass; notes the trace."""
        self.passes += 1
        products, d, b = _products(self.rows), *q.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, squares, some = np.zeros((d, b)), 0.0, False
            for batch in batches:
                for _, xq, back, s in products(batch, q):
                    total += back(xq)
                    squares, some = squares + s, True
            if some:
                flat = np.append(total.ravel(), squares)
                parts = [flat[a : a + CHUNK] for a in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["i", "sums"])

        def add(table: pa.Table) -> pa.Table:
            column = table.column("sums").combine_chunks()
            return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([column.flatten().to_numpy().reshape(len(column), -1).sum(axis=0)], column.type)})

        partial = self.table.mapInArrow(run, "i int, sums array<double>")
        if self.tasks * q.size * 8 > DIRECT_BYTES:
            partial = partial.groupBy("i").applyInArrow(add, "i int, sums array<double>")
        out = np.zeros(d * b + 1)
        for i, part in sorted(((r["i"], r["sums"]) for r in partial.collect()), key=lambda r: r[0]):
            out[i * CHUNK : i * CHUNK + len(part)] += part
        self.trace = out[-1] / self.n
        return out[:-1].reshape(d, b) / self.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``against``; directions lost in rounding are dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        left = np.linalg.norm(block, axis=0)
        block = block[:, left > 1e-10]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s[0])]
    return block


def leading(cov: Covariance, k: int, tol: float = 1e-10, max_passes: int = 300, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns.

    Ends when every residual is below ``tol`` of the largest eigenvalue, or the basis spans all there is; raises otherwise.
    """
    d = cov.rows.dimensions
    k = min(k, d)
    width = min(d, k + SPARE)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max_passes):
        basis, image = np.hstack([basis, block]), np.hstack([image, cov.times(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = turn[:, :k]
        rest = np.linalg.norm(image @ top - basis @ top * values[:k], axis=0)
        done = rest.max(initial=0.0) <= tol * max(values[0], 0.0)
        block = _orthonormal(image[:, -block.shape[1] :], basis)
        if not done and not block.shape[1] and basis.shape[1] < d:  # an invariant space that may miss others
            block = _orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((d, min(width, d - basis.shape[1]))), basis)
        if done or not block.shape[1]:
            return np.maximum(values[:k], 0), basis @ top
        if basis.shape[1] + block.shape[1] > MAX_BLOCKS * width:
            best = turn[:, : 2 * width]
            basis, image = basis @ best, image @ best
            block = _orthonormal(block, basis)
    raise NotConverged(f"components have not settled after {cov.passes} passes; largest residual {rest.max():.1e}")


def principal(rows: Rows, k: int | None, variance: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the total variance and loadings (dimensions x components) of ``k`` components, or of the fewest that reach ``variance``.

    The largest entry of every component is positive.
    """
    cov = Covariance(rows)
    try:
        if not cov.n:
            raise ValueError("no rows")
        ask = k or min(16, rows.dimensions)
        while True:
            values, vectors = leading(cov, ask)
            share = values / cov.trace if cov.trace > 0 else np.zeros(len(values))
            if k or ask >= rows.dimensions or share.sum() >= variance - 1e-12:
                break
            ask = min(2 * ask, rows.dimensions)
    finally:
        cov.close()
    if not k:
        last = min(len(share), int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1))
        share, vectors = share[:last], vectors[:, :last]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return share, vectors * np.where(sign == 0, 1.0, sign)


def project(rows: Rows, loadings: np.ndarray) -> DataFrame:
    """(sample_id, vec): centred rows on the components."""
    products = _products(rows)
    kind = dict(rows.table.dtypes)["sample_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, _, _ in products(batch, loadings):
                yield pa.RecordBatch.from_arrays([batch.column("sample_id").slice(a, len(z)), pa.array(list(z), pa.list_(pa.float64()))], ["sample_id", "vec"])

    return rows.table.select("sample_id", *rows.columns).mapInArrow(run, f"sample_id {kind}, vec array<double>")
