"""Lloyd's method for many numbers of clusters and starts at once.

Every pass assigns all rows to the centres of all runs that have not settled and sends back sums,
counts and squared distances per centre, so a sweep over k costs as many passes as its slowest run.
A run has settled when its centres stay where they are. One that still moves after ``max_iter`` passes must at least be as
settled as the reference's KMeans asks (squared moves of all centres of at most 0.0001 of the mean variance). Moves fade the more slowly
the more rows there are, so until a run is that settled it gets further passes, ``max_iter`` for every doubling of the rows beyond
``ROWS_OF_PASSES``; after these it is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators.batched import NotConverged

#: Rows the first centres are drawn from, per centre of the largest run; a seeded sample of all rows.
SAMPLE_PER_CENTRE, LEAST_SAMPLE = 20, 1000
BLOCK_CELLS = 1 << 20
TOLERANCE, LAST_TOLERANCE = 1e-9, 1e-4
#: Rows up to which ``max_iter`` passes are all a run gets.
ROWS_OF_PASSES = 1000
#: Partial sums of all tasks go to the driver at once up to this size, else they are added up by a shuffle first.
DIRECT_BYTES = 64 << 20


def _first_centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is drawn by its squared distance to those before; fewer if there are fewer distinct points."""
    centres = [points[rng.integers(len(points))]]
    d2 = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and d2.max() > 0:
        centres.append(points[rng.choice(len(points), p=d2 / d2.sum())])
        d2 = np.minimum(d2, ((points - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(16, BLOCK_CELLS // max(1, width))
    for a in range(0, batch.num_rows, step):
        part = batch.column("vec").slice(a, step)
        yield a, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row, the first of equals."""
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def solve(vecs: DataFrame, jobs: Sequence[tuple[int, int]], seed: int = 42, max_iter: int = 300) -> list[tuple[np.ndarray, float]]:
    """Centres and inertia of every (k, start); vecs(sample_id, vec)."""
    data = _spread(vecs.select("sample_id", F.col("vec").cast("array<double>").alias("vec"))).persist()
    try:
        most = max(LEAST_SAMPLE, SAMPLE_PER_CENTRE * max(k for k, _ in jobs))
        drawn = data.orderBy(F.xxhash64(F.lit(seed), F.col("sample_id").cast("string")), "sample_id").limit(most).collect()
        if not drawn:
            raise ValueError("no rows to cluster")
        points = np.array([r["vec"] for r in drawn], float)
        shift, scale = points.mean(axis=0), float(np.abs(points - points.mean(axis=0)).max()) or 1.0
        centres = [_first_centres(points - shift, k, np.random.default_rng((seed, k, s))) for k, s in jobs]
        inertia, moving = np.zeros(len(jobs)), list(range(len(jobs)))
        done, most = 0, max_iter
        while moving and done < most:
            got, done, left = _pass(data, shift, [centres[j] for j in moving]), done + 1, []
            if done == 1:
                most = math.ceil(max_iter * (1 + math.log2(max(1.0, got[0][1].sum() / ROWS_OF_PASSES))))
            for j, (sums, counts, within) in zip(moving, got):
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres[j])
                stays = np.abs(new - centres[j]).max() <= TOLERANCE * scale
                if not stays and (done < max_iter or ((new - centres[j]) ** 2).sum() > LAST_TOLERANCE * points.var(axis=0).mean()):
                    left.append(j)
                centres[j], inertia[j] = new, within
            moving = left
        if not moving:
            return [(c + shift, float(v)) for c, v in zip(centres, inertia)]
        raise NotConverged(f"{len(moving)} of {len(jobs)} runs of k-means have not settled after {done} passes")
    finally:
        data.unpersist()


def _spread(data: DataFrame) -> DataFrame:
    """``data`` in as many partitions as there are cores, if it has enough rows for that; it is passed over many times."""
    tasks = min(data.sparkSession.sparkContext.defaultParallelism, data.count() // ROWS_OF_PASSES)
    return data.repartition(tasks) if _partitions(data) < tasks else data


def _partitions(data: DataFrame) -> int:
    return data._jdf.queryExecution().toRdd().getNumPartitions()


def _pass(data: DataFrame, shift: np.ndarray, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per run: sums and counts of the rows nearest each centre, and the sum of squared distances."""
    d, every = len(shift), sum(len(c) for c in runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, within = [np.zeros((len(c), d + 1)) for c in runs], np.zeros(len(runs))
        for batch in batches:
            for _, x in _blocks(batch, max(d, every)):
                x = x - shift
                for j, c in enumerate(runs):
                    at = nearest(x, c)
                    one = np.zeros((len(x), len(c)))
                    one[np.arange(len(x)), at] = 1
                    sums[j][:, :d] += one.T @ x
                    sums[j][:, d] += one.sum(axis=0)
                    within[j] += ((x - c[at]) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(runs)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array(within)], ["run", "sums", "within"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"run": table.column("run").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary()), "within": pa.array([float(np.sum(table.column("within").to_numpy()))])})

    schema = "run int, sums binary, within double"
    partial = data.mapInArrow(run, schema)
    if _partitions(data) * every * (d + 1) * 8 > DIRECT_BYTES:
        partial = partial.groupBy("run").applyInArrow(add, schema)
    totals, withins = [np.zeros((len(c), d + 1)) for c in runs], np.zeros(len(runs))
    for r in partial.collect():
        totals[r["run"]] += np.frombuffer(r["sums"]).reshape(-1, d + 1)
        withins[r["run"]] += r["within"]
    return [(t[:, :d], t[:, d], float(w)) for t, w in zip(totals, withins)]


def best_runs(vecs: DataFrame, ks: Sequence[int], starts: int, seed: int, max_iter: int) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the run of least inertia, the first of equals."""
    jobs = [(int(k), s) for k in ks for s in range(1 if k == 1 else starts)]
    out: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), (centres, inertia) in zip(jobs, solve(vecs, jobs, seed, max_iter)):
        if k not in out or inertia < out[k][1]:
            out[k] = (centres, inertia)
    return out


def assign(vecs: DataFrame, runs: dict[int, np.ndarray]) -> DataFrame:
    """(k, id, cluster, d): nearest centre of every row in every run, and the distance to it; one pass."""
    kind = dict(vecs.dtypes)["sample_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in _blocks(batch, max(len(c) for c in runs.values())):
                ids = batch.column("sample_id").slice(a, len(x))
                for k, c in runs.items():
                    at = nearest(x - c.mean(axis=0), c - c.mean(axis=0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), k, np.int32)), ids, pa.array(at.astype(np.int32)), pa.array(np.sqrt(((x - c[at]) ** 2).sum(axis=1)))], ["k", "id", "cluster", "d"]
                    )

    return vecs.select("sample_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"k int, id {kind}, cluster int, d double")
