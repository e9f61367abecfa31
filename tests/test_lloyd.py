"""Lloyd's method for many runs at once against single runs recomputed."""

import numpy as np
import pytest

from cohortia.operators import cluster, lloyd
from cohortia.operators.batched import NotConverged


def frame(spark, x):
    return spark.createDataFrame([(f"s{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "sample_id string, vec array<double>").repartition(3)


def blobs(seed=0, k=4, n=30):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(n, 3)) * 0.3 + 10 * rng.normal(size=3) for _ in range(k)])


def test_runs_are_fixed_points_and_find_planted_clusters(spark):
    x = blobs()
    labels, centres, inertia = cluster.kmeans(frame(spark, x), 4)
    got = {r.id: r.cluster for r in labels.collect()}
    at = np.array([got[f"s{i:03d}"] for i in range(len(x))])
    assert all(len(set(at[b : b + 30])) == 1 for b in range(0, 120, 30)) and len(set(at)) == 4
    c = {r.cluster: np.array(r.centre) for r in centres.collect()}
    for k in c:  # a centre is the mean of its members, and no member is nearer to another
        assert np.allclose(c[k], x[at == k].mean(axis=0))
    d2 = np.array([((x - c[k]) ** 2).sum(axis=1) for k in sorted(c)])
    assert (d2.argmin(axis=0) == at).all() and inertia == pytest.approx(d2.min(axis=0).sum())


def test_all_k_in_as_many_passes_as_the_slowest(spark, monkeypatch):
    x = blobs(1, 5, 20)
    passes = []
    plain = lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda data, shift, runs: (passes.append(len(runs)), plain(data, shift, runs))[1])
    rows = {r.k: r.inertia for r in cluster.kmeans_elbow(frame(spark, x), range(1, 9), starts=4).collect()}
    assert passes[0] == 1 + 7 * 4 and passes == sorted(passes, reverse=True) and len(passes) < 40
    assert rows[1] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    assert all(rows[k] >= rows[k + 1] * 0.999 for k in range(1, 5)) and rows[5] < 0.02 * rows[1]


def test_unsettled_runs_are_errors(spark):
    with pytest.raises(NotConverged):
        cluster.kmeans(frame(spark, np.random.default_rng(3).normal(size=(200, 2))), 9, max_iter=1)


def test_fewer_distinct_points_than_clusters(spark):
    x = np.repeat(np.eye(3), 5, axis=0)
    labels, centres, inertia = cluster.kmeans(frame(spark, x), 6)
    assert centres.count() == 3 and inertia == pytest.approx(0) and labels.select("cluster").distinct().count() == 3


def test_sweep_equals_one_k_at_a_time(spark):
    x = blobs(4, 3, 12)
    df = frame(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    dist = spark.createDataFrame([(f"s{i:03d}", f"s{j:03d}", float(d[i, j])) for i in range(36) for j in range(36)], "id_a string, id_b string, d double")
    got = {r.k: r.n_divergent for r in cluster.cluster_count_sweep(df, dist, range(1, 6), 1.0, variance=None).collect()}
    for k in range(1, 6):
        labels, centres, _ = cluster.kmeans(df, k)
        want = cluster.divergent_count(dist, cluster.nearest_to_centroid(df, labels, centres), 1.0).first().n_divergent
        assert got[k] == want
    assert got[1] > got[3] == 0 or got[3] < got[1]
    by_components = {r.k: r.n_divergent for r in cluster.cluster_count_sweep(df, dist, [3], 1.0, variance=1.0).collect()}  # distances stay
    assert by_components[3] == got[3]


@pytest.mark.parametrize("step, settles", [(1e-4, True), (0.5, False)])
def test_runs_that_barely_move_after_the_last_pass_are_settled(spark, monkeypatch, step, settles):
    monkeypatch.setattr(lloyd, "_pass", lambda data, shift, runs: [(c + step, np.ones(len(c)), 1.0) for c in runs])  # centres that never stand still
    df = frame(spark, blobs())
    if settles:
        assert lloyd.solve(df, [(2, 0)], max_iter=5)[0][1] == 1.0
    else:
        with pytest.raises(NotConverged):
            lloyd.solve(df, [(2, 0)], max_iter=5)


def test_runs_over_many_rows_get_more_passes(spark, monkeypatch):
    """Moves fade more slowly the more rows there are: one that is above the tolerance after max_iter passes goes on."""
    passes = []

    def fading(data, shift, runs):
        passes.append(len(runs))
        return [((c + 0.5 ** len(passes)) * 4000, np.full(len(c), 4000.0), 1.0) for c in runs]

    monkeypatch.setattr(lloyd, "_pass", fading)
    assert lloyd.solve(frame(spark, blobs()), [(2, 0)], max_iter=5)[0][1] == 1.0 and 5 < len(passes) < 20
    passes.clear()
    monkeypatch.setattr(lloyd, "_pass", lambda data, shift, runs: (passes.append(1), [((c + 0.5) * 4000, np.full(len(c), 4000.0), 1.0) for c in runs])[1])
    with pytest.raises(NotConverged):
        lloyd.solve(frame(spark, blobs()), [(2, 0)], max_iter=5)
    assert len(passes) == 20  # 8,000 rows are three doublings


def test_sums_are_the_same_with_and_without_a_shuffle(spark, monkeypatch):
    x = blobs(5)
    df, centres = frame(spark, x).persist(), [x[:2].copy(), x[[0, 40, 80]].copy()]
    direct = lloyd._pass(df, np.zeros(3), centres)
    monkeypatch.setattr(lloyd, "DIRECT_BYTES", 0)
    for (s, n, w), (s2, n2, w2), c in zip(direct, lloyd._pass(df, np.zeros(3), centres), centres):
        assert np.allclose(s, s2) and (n == n2).all() and n.sum() == len(x) and w == pytest.approx(w2)
        assert w == pytest.approx(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    df.unpersist()
