"""All-pairs work on dense vectors, block against block.

A pair of blocks meets in one task that holds two blocks of a fixed byte size. Only
reductions leave a task: k best partners, partners above a cutoff, or sums per label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
#: What a row of a block takes in a task besides its vector: objects for the vector, the id and the label.
ROW_BYTES = 512
TILE_CELLS = 1 << 21
#: Most rows of a block where every pair above a cutoff leaves the task, tile by tile.
HIT_ROWS = 1 << 15


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two array columns; null for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def _unit(X: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(X, axis=1, keepdims=True)
    return np.divide(X, n, out=np.zeros_like(X), where=n > 0)


def _tiles(A: np.ndarray, B: np.ndarray, metric: str) -> Iterator[tuple[int, np.ndarray]]:
    """Similarity or distance of row tiles of A against all of B."""
    if metric == "cosine":
        A, B = _unit(A), _unit(B)
    sq = (B * B).sum(axis=1)
    step = max(16, TILE_CELLS // max(1, len(B)))
    for lo in range(0, len(A), step):
        a = A[lo : lo + step]
        if metric == "cosine":
            yield lo, a @ B.T
        else:
            d2, twice = (a * a).sum(axis=1)[:, None] + sq[None, :], a @ B.T
            twice *= 2
            d2 -= twice
            del twice
            # The expanded form cancels for near-equal rows; recompute those directly.
            near = d2 <= 1e-9 * (sq[None, :] + 1)
            if near.any():
                i, j = np.nonzero(near)
                d2[i, j] = ((a[i] - B[j]) ** 2).sum(axis=1)
            np.maximum(d2, 0, out=d2)
            yield lo, np.sqrt(d2, out=d2)
            del d2  # or two tiles are held while the next is made


def block_pairs(
    left: DataFrame, right: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict], pd.DataFrame],
    schema: str, extra: str | None = None, block_rows: int | None = None, metric: str = "cosine", half: bool = False, most_rows: int | None = None, by_id: bool = False, stream: bool = False,
) -> DataFrame:
    """Run ``reduce`` on every (left tile, right block) pair.

    Rows are hashed into blocks of about ``block_rows``, sized so a block of vectors and what Python holds beside them stays below
    about 16 MB and the block pairs occupy every core. Every left block is replicated once per right block and the other way round; the
    replication factor is rows / block_rows, and each task holds one block of either side.
    ``reduce(ids_a, ids_b, values, extra_b)`` sees a tile of similarities and returns rows. ``half`` is
    for one table against itself when both orders of a pair say the same: blocks only meet blocks of
    the same or a larger number, and ``reduce`` gets a fifth argument that is true inside a block.
    ``by_id`` gives ``reduce`` the right rows of a block in the order of their ids. With ``stream``, for ``half`` only, what
    ``reduce`` returns leaves the task tile by tile and a block is sent once to each pair of blocks it is in; nothing but
    its vectors counts for its size, so fewer copies are made.
    """
    dim_row = left.select(F.size("vec").alias("n")).limit(1).first()
    dim = max(1, dim_row["n"] if dim_row else 1)
    nl, nr = left.count(), right.count()
    spread = math.isqrt(left.sparkSession.sparkContext.defaultParallelism) + 1
    rows = block_rows or max(1024, min(BLOCK_BYTES // (8 * dim + (0 if stream else ROW_BYTES)), math.ceil(max(nl, nr) / spread), most_rows or nl + nr + 1024))
    na, nb = max(1, math.ceil(nl / rows)), max(1, math.ceil(nr / rows))
    if stream:
        return _streamed(left, na, reduce, schema, metric)
    ex = F.col(extra).cast("string") if extra else F.lit("")

    def side(df: DataFrame, own: int, other: int, left_side: bool) -> DataFrame:
        df = df.withColumn("own", F.pmod(F.xxhash64("sample_id"), F.lit(own)).cast("int"))
        lo, hi = F.lit(0), F.lit(other - 1)
        if half:
            lo, hi = (F.col("own"), hi) if left_side else (lo, F.col("own"))
        return df.withColumn("partner", F.explode(F.sequence(lo, hi)))

    key = F.col("sample_id").cast("string")
    a = side(left, na, nb, True).select(F.col("own").alias("a_block"), F.col("partner").alias("a_with"), key.alias("a_id"), F.col("vec").alias("a_vec"))
    b = side(right, nb, na, False).select(F.col("partner").alias("b_with"), F.col("own").alias("b_block"), key.alias("b_id"), F.col("vec").alias("b_vec"), ex.alias("b_ex"))

    def run(pa: pd.DataFrame, pb: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pa) and len(pb):
            if by_id:
                pb = pb.iloc[np.argsort(pb["b_id"].to_numpy().astype(str), kind="stable")]
            A, B = np.stack(pa["a_vec"].to_numpy()).astype(float), np.stack(pb["b_vec"].to_numpy()).astype(float)
            ia, ib, eb = pa["a_id"].to_numpy(), pb["b_id"].to_numpy(), pb["b_ex"].to_numpy()
            for lo, vals in _tiles(A, B, metric):
                inner = (bool(pa["a_block"].iloc[0] == pb["b_block"].iloc[0]),) if half else ()
                out.append(reduce(ia[lo : lo + len(vals)], ib, vals, eb, *inner))
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    return a.groupBy("a_block", "a_with").cogroup(b.groupBy("b_with", "b_block")).applyInPandas(run, schema)


def _streamed(vecs: DataFrame, n: int, reduce: Callable, schema: str, metric: str) -> DataFrame:
    """``reduce`` on the tiles of every pair of the ``n`` blocks of one table; a pair of blocks is one task."""
    own = F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int")
    rows = vecs.select(own.alias("own"), F.col("sample_id").cast("string").alias("id"), "vec").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    pair = lo * n - (lo * (lo - 1) / 2).cast("int") + hi - lo
    # Rows of the lower block are side 0; a block that meets itself is side 2.
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, width = {}, {}, None
        for batch in batches:
            sides, vec = batch.column("side").to_numpy(), batch.column("vec")
            sizes = pc.list_value_length(vec)
            width = sizes[0].as_py() if width is None and batch.num_rows else width
            if sizes.null_count or not pc.all(pc.equal(sizes, width), min_count=0).as_py():
                raise ValueError("vectors must have one length")
            x, names = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), -1), batch.column("id").to_numpy(zero_copy_only=False)
            for s in np.unique(sides):
                ids.setdefault(int(s), []).append(names[sides == s])
                held.setdefault(int(s), []).append(x[sides == s])
        ids, held = {s: np.concatenate(v) for s, v in ids.items()}, {s: np.concatenate(held.pop(s)) for s in list(held)}
        for a, b in ((0, 1), (2, 2)):
            if a in held and b in held:
                for lo, vals in _tiles(held[a], held[b], metric):
                    got = reduce(ids[a][lo : lo + len(vals)], ids[b], vals, None, a == b)
                    yield pa.RecordBatch.from_pandas(got, out, preserve_index=False)

    dealt = rows.select(pair.cast("int").alias("pair"), side.alias("side"), "id", "vec").repartitionById(n * (n + 1) // 2, F.col("pair"))
    return dealt.select("side", "id", "vec").mapInArrow(run, schema)


def _own_columns(ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of equal ids; ``ib`` is in the order of its ids."""
    names, own = ib.astype(str), ia.astype(str)
    lo, hi = np.searchsorted(names, own), np.searchsorted(names, own, "right")
    row = np.repeat(np.arange(len(ia)), hi - lo)
    column = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
    same = ia[row] == ib[column]
    return row[same], column[same]


def _best_columns(vals: np.ndarray, k: int, without: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values, at 12 digits, of the ``k`` largest finite cells of every row; the first of equals.

    The k-th largest of the maxima of runs of columns is no more than the k-th largest cell, so only
    the few cells that reach it are rounded and sorted. Overwrites the cells ``without`` and those that are not finite.
    """
    if without is not None:
        vals[without] = -np.inf
    n, m = vals.shape
    width = m // (16 * k)
    if width > 1:
        most = vals[:, : m // width * width].reshape(n, -1, width).max(axis=2)
        if not np.isfinite(most).all():
            vals[~np.isfinite(vals)] = -np.inf
            most = vals[:, : m // width * width].reshape(n, -1, width).max(axis=2)
        least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k : most.shape[1] - k + 1]
        i, j = np.nonzero(vals >= least - 2e-12)  # more than rounding moves a cell
    else:
        i, j = np.nonzero(np.isfinite(vals))
    v = np.round(vals[i, j], 12)
    keep = np.isfinite(v)
    i, j, v = i[keep], j[keep], v[keep]
    order = np.lexsort((j, -v, i))
    i, j, v = i[order], j[order], v[order]
    rank = np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i]
    keep = rank < k
    return i[keep], j[keep], v[keep]


def nearest_k(vecs: DataFrame, k: int = 10, other: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """(id_a, id_b, similarity, rank): the k most similar vectors of each vector, itself excluded.

    With ``other`` the neighbours come from that table and nothing is excluded. Each block pair
    sends at most k candidates per row; equal similarities are decided by id, at 12 digits.
    """
    same = other is None

    def best(ia, ib, vals, _):
        i, j, v = _best_columns(vals, k, _own_columns(ia, ib) if same else None)
        return pd.DataFrame({"id_a": ia[i], "id_b": ib[j], "similarity": v})

    cand = block_pairs(vecs, vecs if same else other, best, "id_a string, id_b string, similarity double", block_rows=block_rows, by_id=True)
    w = Window.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_self_join(vecs: DataFrame, cutoff: float, block_rows: int | None = None) -> DataFrame:
    """(id_a, id_b, similarity) for unordered pairs with cosine above ``cutoff``, id_a < id_b."""

    def above(ia, ib, vals, _, inner):
        i, j = np.nonzero(vals > cutoff)
        a, b = ia[i], ib[j]
        if inner:
            once = (a < b).astype(bool)
            i, j, a, b = i[once], j[once], a[once], b[once]
        swap = a > b
        return pd.DataFrame({"id_a": np.where(swap, b, a), "id_b": np.where(swap, a, b), "similarity": vals[i, j]})

    return block_pairs(vecs, vecs, above, "id_a string, id_b string, similarity double", block_rows=block_rows, half=True, most_rows=HIT_ROWS, stream=True)


def mutual_nearest(vecs_a: DataFrame, vecs_b: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """Pairs that are in each other's k nearest across two tables."""
    ab = nearest_k(vecs_a, k, vecs_b, block_rows)
    ba = nearest_k(vecs_b, k, vecs_a, block_rows).select(F.col("id_a").alias("id_b"), F.col("id_b").alias("id_a"))
    return ab.join(ba, ["id_a", "id_b"], "left_semi").select("id_a", "id_b", "similarity")


def nearest_vector_distance(vecs: DataFrame, reps: DataFrame | None = None, exclude_self: bool = True, block_rows: int | None = None) -> DataFrame:
    """(id, d): Euclidean distance of each vector to the nearest other one, or to the nearest representative."""
    skip = exclude_self and reps is None

    def least(ia, ib, vals, _):
        v = np.where(ia[:, None] == ib[None, :], np.inf, vals) if skip else vals
        return pd.DataFrame({"id": ia, "d": v.min(axis=1)})

    near = block_pairs(vecs, vecs if reps is None else reps, least, "id string, d double", block_rows=block_rows, metric="euclidean")
    return near.where("d < double('infinity')").groupBy("id").agg(F.min("d").alias("d"))


def silhouette(vecs: DataFrame, label: str = "label", block_rows: int | None = None) -> DataFrame:
    """Exact Euclidean silhouette per sample (a cluster of one scores 0); average it for the usual figure.

    A block pair emits one distance sum per (sample, label), never a pair.
    """

    def sums(ia, ib, vals, eb):
        labels, code = np.unique(eb.astype(str), return_inverse=True)
        onehot = np.zeros((len(eb), len(labels)))
        onehot[np.arange(len(eb)), code] = 1.0
        tot = vals @ onehot
        return pd.DataFrame({"id": np.repeat(ia, len(labels)), "other": np.tile(labels, len(ia)), "total": tot.ravel()})

    parts = block_pairs(vecs, vecs, sums, "id string, other string, total double", extra=label, block_rows=block_rows, metric="euclidean")
    tot = parts.groupBy("id", "other").agg(F.sum("total").alias("total"))
    sizes = vecs.groupBy(F.col(label).cast("string").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    own = vecs.select(F.col("sample_id").cast("string").alias("id"), F.col(label).cast("string").alias("label"))
    j = tot.join(sizes, "other").join(own, "id")
    mine = F.col("other") == F.col("label")
    per = j.groupBy("id", "label").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    big = F.greatest("a", "b")
    return per.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull() | (big == 0), 0.0).otherwise((F.col("b") - F.col("a")) / big).alias("silhouette"))


def silhouette_squared(vecs: DataFrame, label: str = "label") -> float:
    """Mean silhouette on squared Euclidean distance by Spark's evaluator; linear in the samples."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    df = vecs.select(array_to_vector("vec").alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(df)
