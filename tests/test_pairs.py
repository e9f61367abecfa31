"""Block against block gives the same pairs however the rows are cut."""

import numpy as np
import pytest

from cohortia.operators import vectors as V


@pytest.mark.parametrize("block_rows", [None, 7])
def test_pairs_and_neighbours(spark, block_rows):
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(40, 4)), 1)
    X[5] = X[9] = X[30]
    ids = [f"v{i}" for i in range(40)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, X)], "sample_id string, vec array<double>")
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(40) for j in range(i) if S[i, j] > 0.5}
    got = [(r.id_a, r.id_b) for r in V.similarity_self_join(df, 0.5, block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = {}
    for r in V.nearest_k(df, 5, block_rows=block_rows).collect():
        near.setdefault(r.id_a, {})[r["rank"]] = r.id_b
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-round(S[i, j], 12), ids[j]))[:5]
        assert [near[ids[i]][k] for k in range(1, 6)] == [ids[j] for j in order]


def test_blocks_of_hits_are_bounded(spark, monkeypatch):
    import pandas as pd

    from cohortia.operators import vectors

    df = spark.range(12000).selectExpr("cast(id as string) sample_id", "array(cast(id % 97 as double), 1.0D) vec")
    sizes = lambda most: [r.n for r in vectors.block_pairs(df, df, lambda ia, ib, vals, _, inner: pd.DataFrame({"n": [len(ib)]}), "n int", half=True, most_rows=most).collect()]
    assert max(sizes(2000)) < 2400 < max(sizes(None))
    asked = []
    monkeypatch.setattr(vectors, "block_pairs", lambda *a, **b: asked.append(b["most_rows"]))
    vectors.similarity_self_join(df, 0.5)
    assert asked == [vectors.HIT_ROWS]


def test_pairs_above_a_cutoff_leave_tile_by_tile_from_few_copies(spark, monkeypatch):
    """A block travels once to each pair it is in, and a task never holds the hits of more than one tile."""
    from cohortia.operators import vectors

    x = np.random.default_rng(2).normal(size=(300, 4))
    df = spark.createDataFrame([(f"v{i}", [float(c) for c in r]) for i, r in enumerate(x)], "sample_id string, vec array<double>").repartition(3)
    copies = []
    plain = type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda self, n, c: (copies.append((n, self.count())), plain(self, n, c))[1])
    got = {(r.id_a, r.id_b): r.similarity for r in vectors.similarity_self_join(df, 0.3, 100).collect()}
    assert copies == [(6, 300 * 3)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"v{i}", f"v{j}"): u[i] @ u[j] for i in range(300) for j in range(300) if f"v{i}" < f"v{j}" and u[i] @ u[j] > 0.3}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert vectors.similarity_self_join(df.where("false"), 0.3).count() == 0
    wrong = df.limit(5).unionByName(df.limit(1).selectExpr("'w' sample_id", "array(1D) vec"))
    with pytest.raises(Exception, match="one length"):
        vectors.similarity_self_join(wrong, 0.3).collect()
