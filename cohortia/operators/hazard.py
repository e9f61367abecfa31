"""Distributed survival learners.

Input rows are (sample_id, vec ARRAY<DOUBLE>, time, event). The Cox gradient needs only scalar
running sums: with H the Breslow cumulative hazard under the current scores, it is the sum of
(event - exp(score) H(time)) x vec. Rows are sorted by time once; one evaluation is two passes over their
blocks without a shuffle; many penalties share the passes as columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cohortia.functions.tails import _lgamma, digamma
from cohortia.operators.ordered import bucket_splits, dominance_totals, running_totals
from cohortia.operators.survival import martingale_residuals
from cohortia.session import cut_lineage, forget

CUT_EVERY = 10
#: Rows of a partition of the forest's fit, about 160 bytes each once unpacked.
TREE_ROWS = 1 << 18


def _linear(B: np.ndarray):
    """Pandas UDF: the scores of a vector under every column of B."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(v.to_numpy()) @ B))

    return score


_TIE = StructType([StructField("h", DoubleType()), StructField("c", DoubleType()), StructField("l", DoubleType())])


def _efron_sums(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Efron sums over l < d of 1/(S0 - l T0/d), (l/d)/(S0 - l T0/d) and log(S0 - l T0/d)."""
    h, ls = np.zeros(s.shape), np.zeros(s.shape)
    one = n == 1
    h[one], ls[one] = 1 / s[one], np.log(s[one])
    ties = n > 1
    if ties.any():  # both sums in closed form, whatever the number of ties
        a = s[ties] * n[ties] / t[ties]
        h[ties] = n[ties] / t[ties] * (digamma(a + 1) - digamma(a - n[ties] + 1))
        ls[ties] = n[ties] * np.log(t[ties] / n[ties]) + _lgamma(a + 1) - _lgamma(a - n[ties] + 1)
    c = np.divide(s * h - n, t, out=np.zeros(s.shape), where=t > 0)
    return h, np.where(n > 0, c, 0.0), ls


@F.pandas_udf(_TIE)
def _efron(s0: pd.Series, t0: pd.Series, d: pd.Series) -> pd.DataFrame:
    """``_efron_sums`` as columns."""
    return pd.DataFrame(dict(zip("hcl", _efron_sums(s0.to_numpy(float), t0.to_numpy(float), d.to_numpy(float)))))


def _steps(s0: np.ndarray, t0: np.ndarray, v: np.ndarray, d: np.ndarray, ties: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hazard steps, tie corrections and loss terms of times (rows) under each column; ``v`` is the sum of the events' scores."""
    d = np.broadcast_to(d[:, None].astype(float), s0.shape)
    has = d > 0
    if ties == "efron":
        h, c, l = _efron_sums(s0, t0, d)
    else:
        s0 = np.maximum(s0, 1e-300)
        h, c, l = d / s0, np.zeros(s0.shape), d * np.log(s0)
    return np.where(has, h, 0.0), np.where(has, c, 0.0), np.where(has, l - v, 0.0)


#: Rows of one block of a Cox problem, and cells of its vectors.
BLOCK_ROWS, BLOCK_CELLS = 1 << 15, 1 << 21
#: Cells of the vectors one task holds.
TASK_CELLS = 1 << 22
#: Partial gradients of all blocks go to the driver at once up to this size, else one more pass adds them up per task.
DIRECT_BYTES = 64 << 20


@dataclass(frozen=True)
class _Block:
    """Rows next to each other in time order, as arrays; ``starts`` are the first rows of its distinct times."""

    id: int
    x: np.ndarray
    event: np.ndarray
    starts: np.ndarray
    d: np.ndarray

    def sums(self, a: np.ndarray) -> np.ndarray:
        return np.add.reduceat(a, self.starts, axis=0)

    def spread(self, a: np.ndarray) -> np.ndarray:
        return np.repeat(a, np.diff(np.append(self.starts, len(self.event))), axis=0)


def _starts(time: np.ndarray) -> np.ndarray:
    new = (time[1:] != time[:-1]) & ~(np.isnan(time[1:]) & np.isnan(time[:-1]))
    return np.flatnonzero(np.append(True, new))


def _unpack(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[_Block]:
    for batch in batches:
        for r in range(batch.num_rows):
            time, event, x = (np.frombuffer(batch.column(c)[r].as_buffer()) for c in ("time", "event", "x"))
            starts = _starts(time)
            yield _Block(batch.column("block")[r].as_py(), x.reshape(-1, p), event[:, None], starts, np.add.reduceat(event, starts))


def _pack(p: int, rows: int):
    """Rows in time order as blocks of ``rows``, with the first and last time and the events there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def block(part: pa.Table, k: int) -> pa.RecordBatch:
            vec = part.column("vec").combine_chunks()
            sizes = pc.list_value_length(vec)
            if sizes.null_count or pc.min(sizes).as_py() != p:  # p is the longest
                raise ValueError("vectors of a Cox model must have one length")
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
            time, event = part.column("time").to_numpy(), part.column("event").to_numpy().astype(float)
            starts = _starts(time)
            d = np.add.reduceat(event, starts)
            row = [first + k, time[0], time[-1], d[0], d[-1] if len(d) > 1 else 0.0, time.tobytes(), event.tobytes(), x.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, row))], _PACKED)

        k = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            while n >= rows:
                yield block(table.slice(0, rows), k)
                table, n, k = table.slice(rows), n - rows, k + 1
            held = table.to_batches()
        if n:
            yield block(pa.Table.from_batches(held), k)

    return run


_PACKED = pa.schema([("block", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("d_lo", pa.float64()), ("d_hi", pa.float64()),
                     ("time", pa.binary()), ("event", pa.binary()), ("x", pa.binary())])


class CoxProblem:
    """Loss and gradient of the Cox partial likelihood for several coefficient columns at once.

    Rows are sorted by time over all tasks once and kept as blocks of arrays. A time belongs to one block unless it is the
    first or last of it, so an evaluation needs no shuffle: a pass sums every block's risk inside and at its two
    ends, the driver adds these up along the blocks, and a second pass steps through each block from there. Only these sums
    (some numbers per block and column) and the gradient's reach the driver; one time may hold any number of rows.
    """

    def __init__(self, data: DataFrame, ties: str = "breslow", block_rows: int = BLOCK_ROWS):
        if ties not in ("breslow", "efron"):
            raise ValueError(f"unknown tie rule {ties}")
        self.ties = ties
        rows = data.where(F.col("time").isNotNull() & F.col("event").isNotNull())
        rows = rows.select("sample_id", "vec", F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"))
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"), F.max(F.size("vec")).alias("p")).first()
        self.n, self.d, self.p = first["n"], first["d"] or 0, first["p"]
        width = max(1, self.p or 0)
        cores = data.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(cores, self.n // 4096), self.n * width // TASK_CELLS)
        # Copies of a time are spread by content, so that a time most rows share is no single task.
        ordered = rows.repartitionByRange(tasks, "time", F.xxhash64("sample_id", "vec")).sortWithinPartitions("time").select("time", "event", "vec")
        packed = ordered.mapInArrow(_pack(width, max(16, min(block_rows, BLOCK_CELLS // width))), "block long, lo double, hi double, d_lo double, d_hi double, time binary, event binary, x binary")
        self.blocks = packed.persist()
        ends = self.blocks.select("block", "lo", "hi", "d_lo", "d_hi").collect()
        lo, hi = (np.array([r[c] for r in ends], float) for c in ("lo", "hi"))
        self.at = {r["block"]: i for i, r in enumerate(ends)}
        self.times, where = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        self.lo, self.hi = where[: len(ends)], where[len(ends):]
        self.ends_d = np.zeros(len(self.times))
        for at, c in ((self.lo, "d_lo"), (self.hi, "d_hi")):
            np.add.at(self.ends_d, at, np.array([r[c] for r in ends], float))

    def close(self) -> None:
        self.blocks.unpersist()

    def _pass(self, one, width: int) -> np.ndarray:
        """What ``one`` makes of each block, ``width`` numbers each, in the order of ``self.lo``."""
        p = self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _unpack(batches, p):
                yield pa.RecordBatch.from_arrays([pa.array([b.id]), pa.array([one(b).tobytes()], pa.binary())], ["block", "v"])

        out = np.zeros((len(self.at), width))
        for r in self.blocks.select("block", "time", "event", "x").mapInArrow(run, "block long, v binary").collect():
            out[self.at[r["block"]]] = np.frombuffer(r["v"])
        return out

    def evaluate(self, B: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log partial likelihood (m,) and gradient (p, m) at coefficient columns B."""
        B = np.asarray(B, dtype=float)
        m, ties, p = B.shape[1], self.ties, B.shape[0]

        def risk(b: _Block) -> np.ndarray:
            s = b.x @ B
            top = s.max(axis=0)
            e = np.exp(s - top)
            cells = [b.sums(e), b.sums(s * b.event), b.sums(e * b.event)]
            last = [c[-1] if len(c) > 1 else np.zeros(m) for c in cells]
            return np.concatenate([top, cells[0][1:-1].sum(axis=0), *[c[0] for c in cells], *last])

        got = self._pass(risk, 8 * m).reshape(-1, 8, m)
        # Scores are taken relative to the largest of their column: the likelihood does not change, and nothing overflows.
        top = got[:, 0].max(axis=0) if len(got) else np.zeros(m)
        scale = np.exp(got[:, 0] - top)
        k = len(self.times)
        e, v, t = (np.zeros((k, m)) for _ in range(3))
        for at, c in ((self.lo, 2), (self.hi, 5)):
            np.add.at(e, at, got[:, c] * scale)
            np.add.at(v, at, got[:, c + 1])
            np.add.at(t, at, got[:, c + 2] * scale)
        v -= self.ends_d[:, None] * top
        # Between two neighbouring ends lies at most one block's inside: the axis is end, inside, end, inside, ...
        axis = np.zeros((2 * k, m))
        axis[0::2] = e
        np.add.at(axis, 2 * self.lo + 1, got[:, 1] * scale)
        s0 = np.cumsum(axis[::-1], axis=0)[::-1][0::2]
        h, c, loss = _steps(s0, t, v, self.ends_d, ties)
        at, lo, hi = self.at, self.lo, self.hi

        def walk(b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Hazard and loss inside a block, the rows' derivative as if no hazard lay before its first time, and their risk."""
            i, n = at[b.id], len(b.starts)
            s = b.x @ B - top
            e = np.exp(s)
            H, C = np.zeros((n, m)), np.zeros((n, m))
            C[0], inner = c[lo[i]], np.zeros((2, m))
            if n > 1:
                C[-1] = c[hi[i]]
            if n > 2:
                E, V, T = (b.sums(a)[1:-1] for a in (e, s * b.event, e * b.event))
                after = s0[hi[i]] + np.cumsum(E[::-1], axis=0)[::-1]
                step, C[1:-1], l = _steps(after, T, V, b.d[1:-1], ties)
                H[1:-1] = np.cumsum(step, axis=0)
                inner = np.stack([step.sum(axis=0), l.sum(axis=0)])
            if n > 1:
                H[-1] = inner[0] + h[hi[i]]
            return inner[0], inner[1], b.event - e * (b.spread(H) - b.event * b.spread(C)), e

        few = len(self.at) * 2 * p * m * 8 <= DIRECT_BYTES

        def steps(b: _Block) -> np.ndarray:
            hazard, l, w, e = walk(b)
            return np.concatenate([hazard, l, *([(b.x.T @ w).ravel(), (b.x.T @ e).ravel()] if few else [])])

        got = self._pass(steps, (2 + (2 * p if few else 0)) * m).reshape(len(self.at), -1, m)
        axis[0::2], axis[1::2] = h, 0.0
        np.add.at(axis, 2 * lo + 1, got[:, 0])
        before = np.cumsum(axis, axis=0)[0::2][lo]  # up to and with the first time of each block
        loss = loss.sum(axis=0) + got[:, 1].sum(axis=0)
        if few:
            g = (got[:, 2 : 2 + p] - got[:, 2 + p :] * before[:, None, :]).sum(axis=0)
        else:
            g = self._gradient(walk, before, p, m)
        return loss / self.n, -g / self.n

    def _gradient(self, walk, before: np.ndarray, p: int, m: int) -> np.ndarray:
        """The gradient where the blocks' shares of it are too large for the driver: added up per task, then by a shuffle."""
        at = self.at

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((p, m))
            for b in _unpack(batches, p):
                _, _, w, e = walk(b)
                acc += b.x.T @ (w - e * before[at[b.id]])
            yield pa.RecordBatch.from_arrays([pa.array([acc.ravel()], pa.list_(pa.float64()))], ["g"])

        sums = self.blocks.select("block", "time", "event", "x").mapInArrow(partial, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        g = np.zeros(p * m)
        for r in sums:
            g[r["i"]] = r["v"]
        return g.reshape(p, m)


def _soft(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


@dataclass(frozen=True)
class CoxPath:
    """Coefficients per penalty: ``coef[:, j]`` belongs to ``grid[j]`` = (l1_ratio, alpha)."""

    grid: list[tuple[float, float]]
    coef: np.ndarray
    loss: np.ndarray
    iterations: int

    def table(self, spark, feature_ids: Sequence[str]) -> DataFrame:
        rows = [(l1, a, f, float(self.coef[i, j])) for j, (l1, a) in enumerate(self.grid) for i, f in enumerate(feature_ids)]
        return spark.createDataFrame(rows, "l1_ratio double, alpha double, feature_id string, weight double")


def solve(problem: CoxProblem, grid: Sequence[tuple[float, float]], factors: np.ndarray | None = None, max_iter: int = 100, tol: float = 1e-5) -> CoxPath:
    """Proximal gradient on all penalties together, each column with its own step length.

    Objective: loss + alpha (l1 sum f|b| + (1 - l1)/2 sum f b^2). A column that fails its
    quadratic bound halves the step and retries; one evaluation serves all columns of a round. Steps follow
    the local curvature (Barzilai & Borwein 1988). Raises if a column has not settled after ``max_iter`` rounds.
    """
    f = np.ones(problem.p) if factors is None else np.asarray(factors, dtype=float)
    l1 = np.array([r * a for r, a in grid])[None, :] * f[:, None]
    l2 = np.array([(1 - r) * a for r, a in grid])[None, :] * f[:, None]
    smooth = lambda b, loss: loss + 0.5 * (l2 * b * b).sum(axis=0)
    m = len(grid)
    cur = np.zeros((problem.p, m))
    loss, grad = problem.evaluate(cur)
    obj, g = smooth(cur, loss), grad + l2 * cur
    step, active = np.ones(m), np.ones(m, dtype=bool)
    it = 0
    for it in range(1, max_iter + 1):
        cand = np.where(active, _soft(cur - step * g, step * l1), cur)
        nl, ng = problem.evaluate(cand)
        delta = cand - cur
        bound = obj + (g * delta).sum(axis=0) + (delta * delta).sum(axis=0) / (2 * step)
        new_obj = smooth(cand, nl)
        good = active & (new_obj <= bound + 1e-12)
        moved = np.abs(delta).max(axis=0)
        turn = (delta * (ng + l2 * cand - g)).sum(axis=0)
        longer = np.clip((delta * delta).sum(axis=0) / np.where(turn > 0, turn, np.inf), step, 100 * step)
        step = np.where(active & ~good, step / 2, np.where(good & (turn > 0), longer, step))
        cur = np.where(good, cand, cur)
        loss, obj = np.where(good, nl, loss), np.where(good, new_obj, obj)
        g = np.where(good, ng + l2 * cand, g)
        active = active & ~(good & (moved < tol))
        if not active.any():
            break
    if active.any():
        raise RuntimeError(f"{int(active.sum())} of {m} penalties not converged after {max_iter} rounds")
    return CoxPath(list(grid), cur, loss, it)


def start_gradient(problem: CoxProblem, factors: np.ndarray | None = None, max_iter: int = 100, tol: float = 1e-5) -> np.ndarray:
    """Gradient where only the features without penalty are fitted; the same for every l1 ratio."""
    f = np.ones(problem.p) if factors is None else np.asarray(factors, dtype=float)
    start = np.zeros((problem.p, 1))
    if (f <= 0).any():
        held = np.where(f > 0, 1e12, 0.0)  # so large a penalty that these stay at zero
        start = solve(problem, [(1.0, 1.0)], held, max_iter, tol).coef
    return problem.evaluate(start)[1]


def alpha_path(problem: CoxProblem, l1_ratio: float, n_alphas: int = 100, alpha_min_ratio: float = 0.01, factors: np.ndarray | None = None, gradient: np.ndarray | None = None) -> list[float]:
    """Geometric path from the smallest alpha that zeroes every penalised coefficient.

    That alpha comes from the gradient after fitting the features without penalty.
    """
    f = np.ones(problem.p) if factors is None else np.asarray(factors, dtype=float)
    g = start_gradient(problem, f) if gradient is None else gradient
    pen = f > 0
    top = float(np.max(np.abs(g[pen, 0]) / f[pen])) / max(l1_ratio, 1e-3) if pen.any() else 1.0
    return [float(a) for a in np.geomspace(top, top * alpha_min_ratio, n_alphas)]


def cox_elastic_net(data: DataFrame, factors: Sequence[float] | None = None, l1_ratios: Sequence[float] = (0.5,), n_alphas: int = 100, alpha_min_ratio: float = 0.01, max_iter: int = 100, tol: float = 1e-5) -> CoxPath:
    """Penalised Cox model over l1 ratios x alpha paths; a factor of 0 leaves a feature unpenalised."""
    problem = CoxProblem(data)
    f = None if factors is None else np.asarray(factors, dtype=float)
    try:
        g = start_gradient(problem, f, max_iter, tol)
        grid = [(r, a) for r in l1_ratios for a in alpha_path(problem, r, n_alphas, alpha_min_ratio, f, g)]
        return solve(problem, grid, f, max_iter, tol)
    finally:
        problem.close()


def cox_ridge(data: DataFrame, alpha: float = 0.01, ties: str = "efron", max_iter: int = 100, tol: float = 1e-5) -> CoxPath:
    problem = CoxProblem(data, ties)
    try:
        return solve(problem, [(0.0, alpha)], None, max_iter, tol)
    finally:
        problem.close()


def risk_scores(data: DataFrame, coef: np.ndarray) -> DataFrame:
    """Rows with their linear predictor as ``score``."""
    return data.withColumn("score", _linear(np.asarray(coef, dtype=float).reshape(-1, 1))("vec")[0])


def average_path(paths: Sequence[CoxPath]) -> list[tuple[float, float]]:
    """Mean alpha per position over the splits' paths, per l1 ratio."""
    out = []
    for r in sorted({l1 for l1, _ in paths[0].grid}):
        rows = [[a for l1, a in p.grid if l1 == r] for p in paths]
        out += [(r, float(np.mean(v))) for v in zip(*rows)]
    return out


def boosted_cox(data: DataFrame, stages: int = 200, rate: float = 0.05, depth: int = 3, seed: int = 42) -> DataFrame:
    """Gradient boosting on the Cox loss: each stage fits a tree to the martingale residuals of the current scores.

    Returns (sample_id, time, event, score). Rows are kept between stages and written to the
    shared folder every ``CUT_EVERY`` stages, which bounds what a lost executor costs.
    """
    base = data.select("sample_id", array_to_vector("vec").alias("features"), F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"))
    cur = cut_lineage(base.withColumn("score", F.lit(0.0)))
    splits = bucket_splits(cur.select("time").distinct(), "time")
    written, kept = cur, cur.persist()
    for stage in range(1, stages + 1):
        cells = cur.groupBy("time").agg(F.sum("event").alias("d"), F.sum(F.exp("score")).alias("e"))
        at = running_totals(cells, [], "time", {"s0": "e"}, ascending=False, splits=splits).withColumn("h", F.col("d") / F.col("s0"))
        H = running_totals(at, [], "time", {"cumulative": "h"}, splits=splits).select("time", "cumulative")
        res = cur.join(H, "time").withColumn("residual", F.col("event") - F.exp("score") * F.col("cumulative")).drop("cumulative")
        tree = DecisionTreeRegressor(maxDepth=depth, labelCol="residual", seed=seed).fit(res)
        nxt = tree.transform(cur).withColumn("score", F.col("score") + rate * F.col("prediction")).drop("prediction")
        cur = cut_lineage(nxt) if stage % CUT_EVERY == 0 else nxt
        older, written = (written, cur) if stage % CUT_EVERY == 0 else (None, written)
        cur = cur.persist()
        cur.count()
        kept.unpersist()
        kept = cur
        if older is not None:
            forget(older)
    return cur.select("sample_id", "time", "event", "score")


def _in_parts(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in at least one partition for every TREE_ROWS of them; fewer stay where they are.

    A tree fit keeps its rows unpacked, in the partitions it is given, and reads them anew for every level.
    """
    parts = -(-n // TREE_ROWS)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else rows


def survival_forest(data: DataFrame, trees: int = 200, depth: int = 5, seed: int = 42) -> DataFrame:
    """Forest regression on null martingale residuals (after LeBlanc & Crowley 1992), a stand-in for log-rank splitting."""
    rows = _in_parts(martingale_residuals(data), data.count()).withColumn("features", array_to_vector("vec"))
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, labelCol="residual", seed=seed).fit(rows)
    return model.transform(data.withColumn("features", array_to_vector("vec"))).select("sample_id", "time", "event", F.col("prediction").alias("score"))


def _ranker_gradient(scored: DataFrame, top: int) -> DataFrame:
    """Rows with ``a``, the derivative of the pairwise squared hinge by their score, and ``l``, their loss; written, the caller forgets it.

    A comparable pair (i dies before j) costs max(0, 1 - (s_i - s_j))^2. Both sides need sums over
    partners whose score crosses the margin, which are dominance sums: no pair is formed.
    """
    pts = cut_lineage(scored.groupBy("key", "event", "s").agg(F.count(F.lit(1)).alias("n")))
    zero = F.lit(0.0)
    # Partners j of an event i: larger key, s_j > s_i - 1. Counted as all larger keys minus s_j <= s_i - 1.
    data = pts.select("key", F.col("s").alias("y"), F.col("n").cast("double").alias("n"), (F.col("n") * F.col("s")).alias("ns"), (F.col("n") * F.col("s") * F.col("s")).alias("nss"))
    asks = pts.where("event = 1").select("key", (F.col("s") - 1).alias("y"), zero.alias("n"), zero.alias("ns"), zero.alias("nss"))
    cols = {"n": "n", "ns": "ns", "nss": "nss"}
    down = dominance_totals(data.unionByName(asks).groupBy("key", "y").agg(*[F.sum(c).alias(c) for c in cols]), [], "key", "y", cols)
    per_key = pts.groupBy("key").agg(*[F.sum(F.col("n") * F.pow("s", F.lit(float(k)))).alias(c) for k, c in enumerate(cols)])
    after = running_totals(per_key, [], "key", {f"{c}_ge": c for c in cols}, ascending=False).select("key", *[(F.col(f"{c}_ge") - F.col(c)).alias(f"{c}_all") for c in cols])
    ev = pts.where("event = 1").withColumn("y", F.col("s") - 1).join(down, ["key", "y"]).join(after, "key")
    over = lambda c: F.col(f"{c}_all") - F.col(f"{c}_lt") - F.col(f"{c}_eq")
    mi = 1 - F.col("s")
    ev = ev.select("key", "event", "s", (-2 * (over("n") * mi + over("ns"))).alias("a1"), (over("n") * mi * mi + 2 * mi * over("ns") + over("nss")).alias("l1"))
    # Events i of a partner j: smaller key, s_i - 1 < s_j. Flip the key axis and query strictly below.
    flip = F.lit(top) - F.col("key")
    src = pts.where("event = 1").select(flip.alias("key"), (F.col("s") - 1).alias("y"), F.col("n").cast("double").alias("n"), (F.col("n") * (1 - F.col("s"))).alias("nm"))
    ask = pts.select(flip.alias("key"), F.col("s").alias("y"), zero.alias("n"), zero.alias("nm"))
    up = dominance_totals(src.unionByName(ask).groupBy("key", "y").agg(F.sum("n").alias("n"), F.sum("nm").alias("nm")), [], "key", "y", {"n": "n", "nm": "nm"})
    up = up.select((F.lit(top) - F.col("key")).alias("key"), F.col("y").alias("s"), (2 * (F.col("nm_lt") + F.col("n_lt") * F.col("y"))).alias("a2"))
    both = pts.select("key", "event", "s").join(ev, ["key", "event", "s"], "left").join(up, ["key", "s"], "left")
    out = cut_lineage(both.select("key", "event", "s", (F.coalesce("a1", zero) + F.coalesce("a2", zero)).alias("a"), F.coalesce("l1", zero).alias("l")))
    forget(pts)
    return out


def survival_ranker(data: DataFrame, alpha: float = 1.0, rank_ratio: float = 1.0, max_iter: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Linear survival support vector machine -> coefficients; a larger score means an earlier event.

    Minimises |w|^2 / 2 + alpha (rank_ratio x mean pair loss + (1 - rank_ratio) x mean regression
    loss) by proximal-free gradient descent with backtracking. The pair loss covers every comparable
    pair exactly. The regression loss asks score ~ -log(time) of events, one-sided for censored rows.
    """
    rows = data.where(F.col("time").isNotNull()).select("sample_id", "vec", F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"))
    dense = running_totals(rows.select("time").distinct().withColumn("one", F.lit(1)), [], "time", {"r": "one"}).drop("one")
    rows = cut_lineage(rows.join(dense, "time").withColumn("key", (F.col("r") - 1) * 2 + (1 - F.col("event"))))
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("top"), F.max(F.size("vec")).alias("p")).first()
    n, top, p = first["n"], int(first["top"]), first["p"]
    pairs = 1.0
    if rank_ratio > 0:
        from cohortia.operators.metrics import comparable_pairs

        pairs = float(comparable_pairs(rows, ()).agg(F.sum("n_pairs")).first()[0] or 1)

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        scored = rows.withColumn("s", _linear(w.reshape(-1, 1))("vec")[0])
        parts = scored.withColumns({"a": F.lit(0.0), "l": F.lit(0.0)})
        if rank_ratio > 0:
            scored = scored.withColumn("s", F.round("s", 9))
            g = _ranker_gradient(scored, top)
            parts = scored.join(g, ["key", "event", "s"])
            mult = scored.groupBy("key", "event", "s").agg(F.count(F.lit(1)).alias("c"))
            rank_loss = g.join(mult, ["key", "event", "s"]).agg(F.sum(F.col("l") * F.col("c"))).first()[0] or 0.0
        else:
            rank_loss = 0.0
        miss = F.col("s") + F.log(F.greatest("time", F.lit(0.5)))
        resid = F.when(F.col("event") == 1, miss).otherwise(F.greatest(miss, F.lit(0.0)))
        parts = parts.select("vec", (F.col("a") * (rank_ratio / pairs) + 2 * resid * ((1 - rank_ratio) / n)).alias("a"), (resid * resid).alias("q"))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc, q = np.zeros(p), 0.0
            for b in batches:
                if len(b):
                    acc += np.stack(b["vec"].to_numpy()).T @ b["a"].to_numpy(float)
                    q += float(b["q"].sum())
            yield pd.DataFrame({"g": [np.append(acc, q)]})

        got = parts.mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        if rank_ratio > 0:
            forget(g)  # or every evaluation stays on disk
        v = np.zeros(p + 1)
        for r in got:
            v[r["i"]] = r["v"]
        loss = alpha * (rank_ratio * rank_loss / pairs + (1 - rank_ratio) * v[p] / n) + 0.5 * float(w @ w)
        return loss, alpha * v[:p] + w

    w = np.zeros(p)
    loss, g = evaluate(w)
    step = 1.0
    for _ in range(max_iter):
        cand = w - step * g
        nl, ng = evaluate(cand)
        if nl <= loss - 0.25 * step * float(g @ g):
            moved = float(np.abs(cand - w).max())
            w, loss, g, step = cand, nl, ng, step * 1.5
            if moved < tol:
                return w
        else:
            step /= 2
            if step < 1e-12:  # no descent left at working precision
                return w
    raise RuntimeError(f"not converged after {max_iter} rounds")
