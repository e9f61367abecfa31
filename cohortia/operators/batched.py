"""Many penalised linear fits in one solve.

All fits of a search share one pass over the rows per step: the coefficients are a matrix with
one column per (penalty, fold, split), and a row counts in a column if the fold it has there is
not the one left out. Nothing is filtered, so the number of jobs does not grow with the grid. Every
column runs its own limited-memory quasi-Newton method (orthant-wise where it has an L1 part)
with its own line search; those that have settled leave the passes, and one that does not
settle is an error.

Rows are (sample_id, vec, label 0/1, weight, folds ARRAY<INT>): entry s of ``folds`` is the row's
fold in slot s, TEST where it only waits to be scored, ABSENT where it takes no part. With a column
``labels`` ARRAY<INT>, entry s is the row's label in slot s, so every slot is a response of its own. The
objective of a fit is sum(w loss) / sum(w) + (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2) / (C n), with n and the
balanced class weights taken from its own training rows; the intercept is not penalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEST, ABSENT = -2, -1
#: Bytes of one coefficient matrix; more columns are solved one matrix after another.
MATRIX_BYTES = 16 << 20
#: Partial sums of all tasks go to the driver at once up to this size, else they are added up by a shuffle first.
DIRECT_BYTES, CHUNK = 64 << 20, 1 << 16
BLOCK_CELLS = 1 << 20
HISTORY, MAX_HALVINGS = 8, 40


class NotConverged(RuntimeError):
    """Some fits did not settle within their steps."""


@dataclass(frozen=True)
class Fits:
    """One entry per fit: the slot it reads, the fold it leaves out (TEST: none), and its penalty."""

    slot: np.ndarray
    left_out: np.ndarray
    C: np.ndarray
    l1_ratio: np.ndarray

    @staticmethod
    def of(rows: Sequence[tuple[int, int, float, float]]) -> Fits:
        s, f, c, r = zip(*rows)
        return Fits(np.array(s, int), np.array(f, int), np.array(c, float), np.array(r, float))

    def take(self, at: np.ndarray) -> Fits:
        return Fits(self.slot[at], self.left_out[at], self.C[at], self.l1_ratio[at])

    def __len__(self) -> int:
        return len(self.slot)


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of margins z for signs y, and its derivative."""
    m = z * y
    e = np.abs(m)
    np.exp(np.negative(e, out=e), out=e)
    slope = np.where(m >= 0, e, 1.0)
    value = np.log1p(e)
    value -= np.minimum(m, 0, out=m)
    e += 1
    slope /= e
    slope *= -y
    return value, slope


def squared_hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = np.maximum(1 - z * y, 0)
    return short * short, -2 * y * short


LOSSES: dict[str, Callable] = {"logistic": logistic, "squared_hinge": squared_hinge}


def _blocks(batch: pa.RecordBatch, centre: np.ndarray, spread: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Standardised vectors, signs (one a row, or one a row and slot), weights and folds of a batch, some rows at a time, and the first row."""
    step = max(16, BLOCK_CELLS // max(1, width))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        m = part.num_rows
        x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
        folds = part.column("folds").flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
        if "labels" in batch.schema.names:
            label = part.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
        else:
            label = part.column("label").to_numpy(zero_copy_only=False)[:, None]
        y = np.where(label > 0, 1.0, -1.0)
        yield (x - centre) / spread, y, part.column("weight").to_numpy(zero_copy_only=False), folds, a


class Problem:
    """Rows prepared for any number of fits; ``close`` lets go of them.

    ``unit[s]`` groups slots that share their training rows apart from the folds (the repeats of one
    outer split): with ``standardise`` vectors are scaled by the moments of the unit's rows, and
    ``keep`` may restrict a unit to some dimensions.
    """

    def __init__(self, rows: DataFrame, loss: str = "logistic", balanced: bool = True, unit: Sequence[int] | None = None, standardise: bool = False, keep: dict[int, Sequence[int]] | None = None):
        self.loss, self.balanced, self.passes, self.tasks = loss, balanced, 0, None
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
        self.own = "labels" in rows.columns
        self.rows = rows.select("sample_id", "vec", F.col("label").cast("int").alias("label"), w.alias("weight"), "folds", *(["labels"] if self.own else [])).persist()
        s = self.rows.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("vec")).alias("s")).select("s.*").first()
        if s is None or not s["count"]:
            raise ValueError("no rows to fit")
        self.centre, std = s["mean"].toArray(), np.sqrt(s["variance"].toArray())
        self.spread = np.where(std > 0, std, 1.0)
        self.d = len(self.centre)
        slots = self.rows.select(F.size("folds")).first()[0]
        self.unit = np.zeros(slots, int) if unit is None else np.asarray(unit, int)
        units = int(self.unit.max()) + 1
        self.keep = np.ones((self.d, units), bool)
        for u, dims in (keep or {}).items():
            self.keep[:, u] = False
            self.keep[list(dims), u] = True
        self._count(units, standardise)

    def close(self) -> None:
        self.rows.unpersist()

    def _count(self, units: int, standardise: bool) -> None:
        """Class counts and weights per (slot, fold), and the moments of every unit's rows."""
        slots = len(self.unit)
        top = self.rows.select(F.max(F.array_max("folds"))).first()[0]
        folds = max(1, int(top) + 1)
        first = np.array([int(np.flatnonzero(self.unit == u)[0]) for u in range(units)])
        centre, spread, d = self.centre, self.spread, self.d
        wide = standardise

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            n = np.zeros((2, 2, slots, folds))  # class; rows or weights
            moments = np.zeros((3, units, d if wide else 1))
            for batch in batches:
                for x, y, w, at, _ in _blocks(batch, centre, spread, max(d, slots)):
                    for c in (0, 1):
                        mine = (y > 0) == bool(c)
                        for f in range(folds):
                            in_fold = mine & (at == f)
                            n[c, 0, :, f] += in_fold.sum(axis=0)
                            n[c, 1, :, f] += w @ in_fold
                    if wide:
                        of_unit = (at[:, first] >= 0).astype(float)
                        moments[0] += of_unit.sum(axis=0)[:, None]
                        moments[1] += of_unit.T @ x
                        moments[2] += of_unit.T @ (x * x)
            yield np.concatenate([n.ravel(), moments.ravel()])

        total = self._summed(sums, 4 * slots * folds + 3 * units * (d if wide else 1))
        self.counts = total[: 4 * slots * folds].reshape(2, 2, slots, folds)
        if standardise:
            n, one, two = total[4 * slots * folds :].reshape(3, units, d)
            mean = one / np.maximum(n, 1)
            var = np.maximum(two / np.maximum(n, 1) - mean**2, 0)
            self.mean, self.std = mean.T, np.where(var > 1e-12, np.sqrt(var), 1.0).T
        else:  # fits see the vectors as they are
            self.mean = np.repeat((-self.centre / self.spread)[:, None], units, 1)
            self.std = np.repeat((1 / self.spread)[:, None], units, 1)

    def _summed(self, sums: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
        """One array per task, added up."""
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for total in sums(batches):
                parts = [total[a : a + CHUNK].tobytes() for a in range(0, len(total), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["i", "sums"])

        def add(table: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
            return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([whole.tobytes()], pa.binary())})

        partial = self.rows.mapInArrow(run, "i int, sums binary")  # bytes: no Python object per number on the driver
        if self.tasks is None:
            self.tasks = self.rows.select(F.spark_partition_id().alias("p")).distinct().count()
        if self.tasks * size * 8 > DIRECT_BYTES:
            partial = partial.groupBy("i").applyInArrow(add, "i int, sums binary")
        out = np.zeros(size)
        for i, part in sorted(((r["i"], r["sums"]) for r in partial.collect()), key=lambda r: r[0]):
            out[i * CHUNK : i * CHUNK + len(part) // 8] += np.frombuffer(part)
        return out

    def training(self, fits: Fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per fit: rows, and weight sums and row counts by class, of its training rows."""
        n = self.counts[:, :, fits.slot, :].sum(axis=3)
        at = np.flatnonzero(fits.left_out >= 0)
        n[:, :, at] -= self.counts[:, :, fits.slot[at], fits.left_out[at]]
        return n[:, 0].sum(axis=0), n[:, 1], n[:, 0]

    def fittable(self, fits: Fits) -> np.ndarray:
        """Which fits have both classes among their training rows."""
        return (self.training(fits)[2] > 0).all(axis=0)

    def seen(self, fits: Fits, inner: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts in the scale each fit sees: that of its unit's moments, or of the vectors as they are."""
        u = self.unit[fits.slot]
        return inner * self.std[:, u], b0 + (self.mean[:, u] * inner).sum(axis=0)

    def original(self, inner: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts for the vectors as they were given."""
        outer = inner / self.spread[:, None]
        return outer, b0 - self.centre @ outer

    def evaluate(self, fits: Fits, inner: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean loss of every fit and its gradient in inner coefficients and intercepts, in one pass."""
        n, weights, rows = self.training(fits)
        scale = n / np.maximum(2 * rows, 1) if self.balanced else np.ones_like(rows)
        whole = (weights * scale).sum(axis=0)
        loss, centre, spread, d, k = LOSSES[self.loss], self.centre, self.spread, self.d, len(fits)
        slot, left_out, own = fits.slot, fits.left_out, self.own

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros((d + 2, k))
            for batch in batches:
                for x, y, wt, folds, _ in _blocks(batch, centre, spread, max(d, k)):
                    at, sign = folds[:, slot], y[:, slot] if own else y
                    inside = np.where(sign > 0, scale[1], scale[0])
                    inside *= wt[:, None]
                    inside *= (at >= 0) & (at != left_out)
                    z = x @ inner
                    z += b0
                    value, slope = loss(z, sign)
                    slope *= inside
                    value *= inside
                    total[:d] += x.T @ slope
                    total[d] += slope.sum(axis=0)
                    total[d + 1] += value.sum(axis=0)
            yield total.ravel()

        total = self._summed(sums, (d + 2) * k).reshape(d + 2, k) / whole
        return total[d + 1], total[:d] * self.keep[:, self.unit[fits.slot]], total[d]

    def scores(self, fits: Fits, inner: np.ndarray, b0: np.ndarray, columns: str = "sample_id string, label int, weight double") -> DataFrame:
        """(fit, sample_id, label, weight, score, pred): margins of the rows each fit has left out; the label is that of the fit's slot."""
        centre, spread, d, slot, left_out, own = self.centre, self.spread, self.d, fits.slot, fits.left_out, self.own

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, y, _, folds, a in _blocks(batch, centre, spread, max(d, len(slot))):
                    i, k = np.nonzero(folds[:, slot] == left_out)
                    z = (x @ inner + b0)[i, k]
                    named = [batch.column(c).slice(a, len(x)).take(pa.array(i)) for c in ("sample_id", "label", "weight")]
                    if own:
                        named[1] = pa.array((y[i, slot[k]] > 0).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *named, pa.array(z), pa.array((z > 0).astype(np.int32))], ["fit", "sample_id", "label", "weight", "score", "pred"])

        return self.rows.mapInArrow(run, f"fit int, {columns}, score double, pred int")


def solve(problem: Problem, fits: Fits, max_iter: int = 500, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Inner coefficients (dimensions x fits) and intercepts of all fits: those of the vectors as the passes scale them.

    A fit has settled when no entry of its (sub)gradient exceeds ``tol``, relative to the first one if that is above 1. One that has not
    after ``max_iter`` steps is an error.
    """
    most = max(1, MATRIX_BYTES // (8 * (problem.d + 1)))
    w, b = np.zeros((problem.d, len(fits))), np.zeros(len(fits))
    for a in range(0, len(fits), most):
        at = np.arange(a, min(a + most, len(fits)))
        w[:, at], b[at] = _solve(problem, fits.take(at), max_iter, tol)
    return w, b


def _two_loop(g: np.ndarray, s: np.ndarray, y: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Quasi-Newton direction of every column; an empty place of the history has rho 0."""
    q, alpha = g.copy(), np.zeros((HISTORY, g.shape[1]))
    for j in range(HISTORY - 1, -1, -1):
        alpha[j] = rho[j] * (s[j] * q).sum(axis=0)
        q -= alpha[j] * y[j]
    newest = np.where(rho[-1] > 0, 1 / np.maximum(rho[-1] * (y[-1] ** 2).sum(axis=0), 1e-300), 1.0)
    q *= newest
    for j in range(HISTORY):
        q += s[j] * (alpha[j] - rho[j] * (y[j] * q).sum(axis=0))
    return -q


def _solve(problem: Problem, fits: Fits, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    d, k = problem.d, len(fits)
    n = problem.training(fits)[0]
    strength = 1 / (fits.C * np.maximum(n, 1))
    # The penalty is on what a fit sees; the steps are taken where all dimensions have one scale.
    std = problem.std[:, problem.unit[fits.slot]]
    one, two = strength * fits.l1_ratio * std, strength * (1 - fits.l1_ratio) * std**2

    def evaluate(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smooth part with the L2 penalty, L1 penalty included in the value only."""
        value, gw, gb = problem.evaluate(fits.take(at), x[:d], x[d])
        return value + (two[:, at] * x[:d] ** 2).sum(axis=0) / 2 + (one[:, at] * np.abs(x[:d])).sum(axis=0), np.vstack([gw + two[:, at] * x[:d], gb])

    kept = np.vstack([problem.keep[:, problem.unit[fits.slot]], np.ones(k, bool)])

    def sub(x: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The steepest subgradient: at 0 the L1 part takes what it can of the gradient."""
        out = g.copy()
        v = x[:d]
        out[:d] += one[:, at] * np.sign(v)
        flat = np.sign(g[:d]) * np.maximum(np.abs(g[:d]) - one[:, at], 0)
        out[:d] = np.where((v == 0) & (one[:, at] > 0), flat, out[:d])
        return out * kept[:, at]

    x = np.zeros((d + 1, k))
    value, g = evaluate(x, np.arange(k))
    pg = sub(x, g, np.arange(k))
    least = tol * np.maximum(1, np.abs(pg).max(axis=0))
    s, y, rho = np.zeros((HISTORY, d + 1, k)), np.zeros((HISTORY, d + 1, k)), np.zeros((HISTORY, k))
    step, direction, halved, steps = np.ones(k), np.zeros((d + 1, k)), np.zeros(k, int), np.zeros(k, int)
    fresh = np.ones(k, bool)
    open_ = np.abs(pg).max(axis=0) > least
    while open_.any():
        at = np.flatnonzero(open_)
        new = at[fresh[at]]
        if len(new):
            p = _two_loop(pg[:, new], s[:, :, new], y[:, :, new], rho[:, new])
            p[:d] = np.where((one[:, new] > 0) & (p[:d] * pg[:d, new] > 0), 0, p[:d])
            bad = (p * pg[:, new]).sum(axis=0) >= 0
            p[:, bad] = -pg[:, new][:, bad]
            direction[:, new] = p
            first = (rho[-1, new] == 0) | bad
            step[new] = np.where(first, 1 / np.maximum(1, np.sqrt((pg[:, new] ** 2).sum(axis=0))), 1.0)
            halved[new], fresh[new] = 0, False
        trial = x[:, at] + step[at] * direction[:, at]
        side = np.where(x[:d, at] != 0, np.sign(x[:d, at]), -np.sign(pg[:d, at]))
        trial[:d] = np.where((one[:, at] > 0) & (np.sign(trial[:d]) != side), 0, trial[:d])
        got, slope = evaluate(trial, at)
        gain = (pg[:, at] * (trial - x[:, at])).sum(axis=0)
        good = got <= value[at] + 1e-4 * np.minimum(gain, 0) + 4e-16 * np.abs(value[at])
        ok, no = at[good], at[~good]
        step[no] /= 2
        halved[no] += 1
        if len(ok):
            moved, change = trial[:, good] - x[:, ok], slope[:, good] - g[:, ok]
            curve = (moved * change).sum(axis=0)
            useful = curve > 1e-14 * (change**2).sum(axis=0)
            learn = ok[useful]
            s[:-1, :, learn], y[:-1, :, learn], rho[:-1, learn] = s[1:, :, learn], y[1:, :, learn], rho[1:, learn]
            s[-1][:, learn], y[-1][:, learn], rho[-1, learn] = moved[:, useful], change[:, useful], 1 / curve[useful]
            x[:, ok], g[:, ok], value[ok] = trial[:, good], slope[:, good], got[good]
            pg[:, ok] = sub(x[:, ok], g[:, ok], ok)
            steps[ok] += 1
            fresh[ok] = True
            open_[ok] = np.abs(pg[:, ok]).max(axis=0) > least[ok]
        # No step lowers the value any more: rounding is all that is left, or the history misleads.
        stuck = no[halved[no] > MAX_HALVINGS]
        if len(stuck):
            settled = np.abs(pg[:, stuck]).max(axis=0) <= 1e3 * least[stuck]
            open_[stuck[settled]] = False
            again = stuck[~settled]
            if (rho[:, again] == 0).all(axis=0).any():
                raise NotConverged("no step lowers the objective of a fit")
            rho[:, again], fresh[again] = 0, True
        late = np.flatnonzero(open_ & (steps >= max_iter))
        if len(late):
            worst = float(np.abs(pg[:, late]).max())
            raise NotConverged(f"{len(late)} of {k} fits have not settled after {max_iter} steps; largest gradient entry {worst:.1e}")
    return x[:d], x[d]
