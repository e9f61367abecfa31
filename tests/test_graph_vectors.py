"""Nearest neighbours and propagation: the quick ways against plain ones."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import graph, vectors


def plain_best(ia, ib, vals, k, same):
    out = []
    for a, row in zip(ia, vals):
        cells = [(-round(v, 12), b, v) for b, v in zip(ib, row) if np.isfinite(v) and not (same and a == b)]
        out += [(a, b, -r) for r, b, _ in sorted(cells, key=lambda c: c[:2])[:k]]
    return sorted(out)


@pytest.mark.parametrize("columns, k", [(1, 3), (40, 10), (700, 2), (900, 5)])
def test_best_columns_are_those_of_a_full_sort(columns, k):
    rng = np.random.default_rng(columns)
    ib = np.sort(np.array([f"{x:04d}" for x in rng.integers(0, columns + 1, columns)])).astype(object)
    ia = np.array([f"{x:04d}" for x in rng.integers(0, columns + 1, 30)], object)
    vals = np.round(rng.standard_normal((30, columns)), 1) + rng.choice([0, 1e-13, -1e-13], (30, columns))  # many equals
    vals[3, :] = np.nan
    vals[5, columns // 2] = np.nan
    for same in (True, False):
        i, j, v = vectors._best_columns(vals.copy(), k, vectors._own_columns(ia, ib) if same else None)
        got = sorted(zip(ia[i], ib[j], v))
        expect = plain_best(ia, ib, vals, k, same)
        assert got == expect


@pytest.mark.parametrize("width", [1, 2, 32])
def test_vectors_propagate_like_cells(spark, width):
    rng = np.random.default_rng(4)
    rows = [(f"n{k}", rng.standard_normal(5).tolist()) for k in range(12)] + [("short", [1.0, 2.0]), ("null", [None, 3.0, None, 1.0, 2.0]), ("n3", [1.0] * 5), ("none", None), (None, [9.0] * 7), ("empty", [])]
    vecs = spark.createDataFrame(rows, "sample_id string, vec array<double>")
    ids = [r[0] for r in rows[:14]] + ["none", "far"]
    edges = spark.createDataFrame([(ids[a], ids[b], float(w)) for a, b, w in zip(rng.integers(0, 16, 60), rng.integers(0, 16, 60), rng.random(60))], "src string, dst string, weight double")
    long = vecs.select("sample_id", F.posexplode("vec").alias("i", "value")).select("sample_id", F.col("i").cast("string").alias("feature_id"), "value")
    for steps in (1, 2):
        expect = {}
        for r in graph.graph_propagate(edges, long, steps).collect():
            expect.setdefault(r["sample_id"], [0.0] * 5)[int(r["feature_id"])] = r["value"] or 0.0
        got = {r["sample_id"]: r["vec"] for r in graph.propagate_vectors(edges, vecs, steps, width=width).collect()}
        assert set(got) == set(expect)
        for key, value in expect.items():
            assert np.allclose(got[key], value)


def test_an_edge_is_one_row_of_a_step_not_one_per_dimension(spark):
    """Fails where cells are propagated one by one: the join then has edges x dimensions rows."""
    vecs = spark.createDataFrame([(f"n{k}", [float(k)] * 20, k % 2) for k in range(6)], "sample_id string, vec array<double>, label int")
    edges = spark.createDataFrame([("n0", "n1", 1.0), ("n1", "n0", 1.0)], "src string, dst string, weight double")
    seen = []
    real = graph.cut_lineage
    try:
        graph.cut_lineage = lambda df: seen.append(df.count()) or real(df)
        graph.graph_features_classify(edges, vecs, 2)
    finally:
        graph.cut_lineage = real
    assert max(seen) <= 8  # 2 edges, 6 self loops


def test_blocks_count_what_python_holds_beside_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1100 * 520)
    vecs = spark.range(6000).select(F.col("id").cast("string").alias("sample_id"), F.array(F.col("id").cast("double")).alias("vec"))
    sizes = lambda ia, ib, vals, _: __import__("pandas").DataFrame({"a": [len(ia)], "b": [len(ib)]})
    got = vectors.block_pairs(vecs, vecs, sizes, "a long, b long", metric="euclidean").agg(F.max("b"), F.sum(F.col("a") * F.col("b"))).first()
    assert got[0] <= 1300 and got[1] == 6000 * 6000


def test_a_tile_of_distances_is_made_in_little_memory():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2048, 4))
    for _ in vectors._tiles(x[:32], x, "euclidean"):
        pass
    tracemalloc.start()
    got = [d.sum() for _, d in vectors._tiles(x, x, "euclidean")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 8 * vectors.TILE_CELLS and len(got) == 2
    plain = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(next(d for _, d in vectors._tiles(x[:50], x, "euclidean")), plain)
