"""Principal components of dense and sparse rows against a full eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import components as C
from cohortia.operators import learn as L
from cohortia.plans import studies


def vectors(spark, x):
    return spark.createDataFrame([(f"s{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "sample_id string, vec array<double>").repartition(3)


def reference(x):
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    return e[::-1], u[:, ::-1], y


@pytest.mark.parametrize(("n", "d", "k"), [(40, 6, None), (30, 60, 5), (25, 200, 24), (50, 3, 3), (1, 4, 2), (200, 120, 7)])
def test_components_of_vectors(spark, n, d, k):
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + rng.normal(size=d)
    e, u, y = reference(x)
    lat = L.pca(vectors(spark, x), k, 0.9)
    m = len(lat.variance)
    if k is None:
        assert m == int(np.searchsorted(np.cumsum(e / e.sum()), 0.9) + 1)
    else:
        assert m == k
    if e.sum() > 0:
        real = min(m, n - 1)
        assert np.allclose(lat.variance, e[:m] / e.sum(), atol=1e-9)
        assert np.allclose(np.abs(u[:, :real].T @ lat.loadings[:, :real]), np.eye(real), atol=1e-6)
    scores = {r.sample_id: r.vec for r in lat.scores.collect()}
    assert np.allclose([scores[f"s{i:03d}"] for i in range(n)], y @ lat.loadings)


def test_equal_variances_and_condensed_basis(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_BLOCKS", 3)
    monkeypatch.setattr(C, "SPARE", 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 80))
    e, _, _ = reference(x)
    assert np.allclose(L.pca(vectors(spark, x), 4).variance, e[:4] / e.sum(), atol=1e-9)
    x = np.kron(np.eye(8), np.ones((4, 1)))
    e, _, _ = reference(x)
    assert np.allclose(L.pca(vectors(spark, x), 7).variance, e[:7] / e.sum(), atol=1e-9)


def cells(spark, x, drop_zeros):
    rows = [(f"s{i:02d}", f"{'ab'[j % 2]}{j:02d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v or not drop_zeros]
    df = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    return {m: df.where(F.col("feature_id").startswith(m)).withColumn("modality", F.lit(m)) for m in "ab"}


def test_absent_cells_count_like_written_zeros(spark):
    """The stored form of a zero makes no difference, and both equal the matrix that is standardised in full."""
    rng = np.random.default_rng(4)
    x = rng.poisson(0.8, size=(30, 12)).astype(float)
    x[:, 0] += 1
    results = []
    for drop in (False, True):
        lat, _, ids = L.joint_latent(cells(spark, x, drop), 4)
        scores = {r.sample_id: r.vec for r in lat.scores.collect()}
        results.append((lat.variance, np.abs(lat.loadings), np.abs([scores[f"s{i:02d}"] for i in range(30)])))
    for a, b in zip(*results):
        assert np.allclose(a, b, atol=1e-8)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    order = sorted(range(12), key=lambda j: f"{'ab'[j % 2]}{j:02d}")
    e, _, _ = reference(z[:, order])
    assert np.allclose(results[1][0], e[:4] / e.sum(), atol=1e-9)
    assert np.allclose((results[1][2] ** 2).mean(axis=0), e[:4], rtol=1e-8)


def test_reconstruction_error_is_what_the_components_leave(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(0.7, size=(24, 8)).astype(float) + np.eye(24, 8)
    labels = spark.createDataFrame([(f"s{i:02d}", i % 2) for i in range(24)], "sample_id string, label int")
    got = []
    for drop in (False, True):
        got.append({r.metric: r.value for r in studies.representation_report(cells(spark, x, drop), labels, 3, 2).collect()})
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    e, u, _ = reference(z)
    left = (z - z @ u[:, :3] @ u[:, :3].T) ** 2
    for report in got:
        assert report["mse_a"] == pytest.approx(left[:, 0::2].mean()) and report["mse_b"] == pytest.approx(left[:, 1::2].mean())
        assert report["explained_variance"] == pytest.approx(e[:3].sum() / e.sum())
    assert got[0]["mean_pearson"] == pytest.approx(got[1]["mean_pearson"])

