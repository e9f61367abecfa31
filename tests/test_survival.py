"""Survival operators against direct NumPy computations on small samples with ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import hazard as H
from cohortia.operators import metrics as M
from cohortia.operators import survival as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 90
    X = rng.normal(size=(n, 3))
    t = np.ceil(rng.exponential(6, n) * np.exp(-0.6 * X[:, 0]))
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(str(i), [float(v) for v in X[i]], float(t[i]), int(e[i])) for i in range(n)], "sample_id string, vec array<double>, time double, event int")
    return X, t, e, df.persist()


def c_brute(t, e, s):
    conc = tied = comp = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] and (t[i] < t[j] or (t[i] == t[j] and not e[j])):
                comp += 1
                conc += s[j] < s[i]
                tied += s[j] == s[i]
    return conc, tied, comp


@pytest.mark.parametrize("rows_per_bucket", [None, 10])
def test_c_index(data, rows_per_bucket):
    X, t, e, df = data
    s = np.round(X[:, 0], 1)
    rows = df.withColumn("score", F.round(F.col("vec")[0], 1)).withColumn("cohort", F.lit("a"))
    got = M.c_index(rows, rows_per_bucket=rows_per_bucket).first()
    conc, tied, comp = c_brute(t, e, s)
    assert (got.concordant, got.tied, got.comparable) == (conc, tied, comp)
    assert got.c_index == pytest.approx((conc + tied / 2) / comp)


def test_c_index_without_groups_and_reversed(data):
    X, t, e, df = data
    a = M.c_index(df.withColumn("score", F.col("vec")[0]), by=()).first().c_index
    b = M.c_index(df.withColumn("score", -F.col("vec")[0]), by=()).first().c_index
    assert a + b == pytest.approx(1.0)


def cox_brute(X, t, e, b, ties):
    s = X @ b
    loss, g = 0.0, np.zeros(len(b))
    for u in np.unique(t[e == 1]):
        risk, ev = t >= u, (t == u) & (e == 1)
        d, w = ev.sum(), np.exp(s)
        for l in range(d):
            f = l / d if ties == "efron" else 0.0
            den = w[risk].sum() - f * w[ev].sum()
            num = (w[risk, None] * X[risk]).sum(0) - f * (w[ev, None] * X[ev]).sum(0)
            loss += np.log(den)
            g += num / den
        loss -= s[ev].sum()
        g -= X[ev].sum(0)
    return loss / len(t), g / len(t)


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_cox_loss_and_gradient(data, ties):
    X, t, e, df = data
    p = H.CoxProblem(df, ties)
    B = np.array([[0.0, 0.4], [0.0, -0.2], [0.0, 0.1]])
    loss, g = p.evaluate(B)
    p.close()
    for j in range(2):
        want_l, want_g = cox_brute(X, t, e, B[:, j], ties)
        assert loss[j] == pytest.approx(want_l)
        assert g[:, j] == pytest.approx(want_g)


def test_efron_closed_form_agrees_with_direct_sum():
    import pandas as pd

    s, t, d = pd.Series([50.0, 900.0, 3.0]), pd.Series([20.0, 30.0, 2.0]), pd.Series([7.0, 12.0, 2.0])
    got = H._efron.func(s, t, d)
    for i in range(3):
        den = s[i] - np.arange(d[i]) / d[i] * t[i]
        share = np.arange(d[i]) / d[i]
        assert np.allclose(got.iloc[i], [(1 / den).sum(), (share / den).sum(), np.log(den).sum()])


def test_large_scores_do_not_overflow(data):
    X, t, e, df = data
    p = H.CoxProblem(df)
    B = np.array([[0.4], [-0.2], [0.1]])
    loss, g = p.evaluate(B)
    shifted = df.withColumn("vec", F.transform("vec", lambda x: x + 3000.0))
    q = H.CoxProblem(shifted)
    loss2, g2 = q.evaluate(B)  # a common shift of every score by 900
    p.close(), q.close()
    assert loss2 == pytest.approx(loss, rel=1e-6) and np.isfinite(g2).all()


def test_cox_sums_do_not_depend_on_blocks(data):
    """A time that fills whole blocks, blocks of a few rows, and sums too large for the driver give the same figures."""
    X, t, e, df = data
    t2 = np.where(t >= 3, 3.0, t)  # most rows share one time
    same = df.withColumn("time", F.least("time", F.lit(3.0)))
    B = np.array([[0.0, 0.4], [0.3, -0.2], [0.0, 0.1]])
    for rows, times in ((df, t), (same, t2)):
        for ties in ("breslow", "efron"):
            p = H.CoxProblem(rows, ties, block_rows=16)
            assert len(p.at) > 3
            loss, g = p.evaluate(B)
            p.close()
            for j in range(2):
                want_l, want_g = cox_brute(X, times, e, B[:, j], ties)
                assert loss[j] == pytest.approx(want_l) and g[:, j] == pytest.approx(want_g)


def test_cox_gradient_added_up_per_task(data, monkeypatch):
    X, t, e, df = data
    B = np.array([[0.4], [-0.2], [0.1]])
    monkeypatch.setattr(H, "DIRECT_BYTES", 0)
    p = H.CoxProblem(df, "efron", block_rows=16)
    loss, g = p.evaluate(B)
    p.close()
    want_l, want_g = cox_brute(X, t, e, B[:, 0], "efron")
    assert loss[0] == pytest.approx(want_l) and g[:, 0] == pytest.approx(want_g)


def test_cox_evaluation_runs_no_shuffle(data):
    """Each evaluation was an aggregate, two windows and a join; now the blocks of one sort serve all of them."""
    *_, df = data
    p = H.CoxProblem(df)
    plans = []
    blocks = p.blocks
    class Seen:
        def select(self, *c):
            out = blocks.select(*c)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out
    p.blocks = Seen()
    p.evaluate(np.zeros((3, 2)))
    blocks.unpersist()
    assert len(plans) == 2 and all(x.split("InMemoryRelation")[0].count("Exchange") == 0 for x in plans)


def test_cox_vectors_of_two_lengths_are_an_error(data):
    *_, df = data
    with pytest.raises(Exception, match="one length"):
        H.cox_ridge(df.withColumn("vec", F.when(F.col("sample_id") == "3", F.slice("vec", 1, 2)).otherwise(F.col("vec"))))


def test_unsettled_fits_are_errors(data):
    *_, df = data
    with pytest.raises(RuntimeError, match="not converged"):
        H.cox_ridge(df, 0.01, max_iter=1)
    with pytest.raises(RuntimeError, match="not converged"):
        H.survival_ranker(df, 1.0, 1.0, max_iter=1)


def test_cox_elastic_net_path(data):
    X, t, e, df = data
    path = H.cox_elastic_net(df, None, (0.9,), 3, 0.05)
    assert np.allclose(path.coef[:, 0], 0, atol=1e-6)  # the largest alpha zeroes all
    assert path.coef[0, -1] > 0.2 and abs(path.coef[0, -1]) > abs(path.coef[1:, -1]).max()


def test_unpenalised_factor_survives(data):
    *_, df = data
    path = H.cox_elastic_net(df, [0, 1, 1], (1.0,), 2, 0.5)
    assert path.coef[0, 0] != 0


def test_cox_two_group_matches_newton(data):
    X, t, e, df = data
    got = S.cox_two_group(df.withColumn("g", (F.col("vec")[0] > 0).cast("int")), "g").first()
    x = (X[:, 0] > 0).astype(float)[:, None]
    eps = 1e-6
    assert cox_brute(x, t, e, np.array([got.coef]), "breslow")[1][0] == pytest.approx(0, abs=1e-7)
    h = (cox_brute(x, t, e, np.array([got.coef + eps]), "breslow")[1] - cox_brute(x, t, e, np.array([got.coef - eps]), "breslow")[1]) / (2 * eps) * len(t)
    assert got.se == pytest.approx(1 / np.sqrt(h[0]), rel=1e-4)


def test_ranker_gradient(data):
    X, t, e, df = data
    w = np.array([0.5, -0.3, 0.2])
    s = np.round(X @ w, 9)
    _, r = np.unique(t, return_inverse=True)
    key = r * 2 + (1 - e)
    scored = df.sparkSession.createDataFrame([(int(key[i]), int(e[i]), float(s[i])) for i in range(len(t))], "key int, event int, s double")
    got = {(r.key, r.event, round(r.s, 9)): (r.a, r.l) for r in H._ranker_gradient(scored, int(key.max())).collect()}
    for i in range(len(t)):
        a = l = 0.0
        for j in range(len(t)):
            if e[i] and key[i] < key[j] and 1 - (s[i] - s[j]) > 0:
                a -= 2 * (1 - s[i] + s[j])
                l += (1 - s[i] + s[j]) ** 2
            if e[j] and key[j] < key[i] and 1 - (s[j] - s[i]) > 0:
                a += 2 * (1 - s[j] + s[i])
        assert got[(key[i], e[i], round(float(s[i]), 9))] == pytest.approx((a, l), abs=1e-6)


def test_ranker_orders_patients(data):
    X, t, e, df = data
    s = X @ H.survival_ranker(df, 1.0, 1.0)
    conc, tied, comp = c_brute(t, e, s)
    assert (conc + tied / 2) / comp > 0.6


def test_kaplan_meier_reaches_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 1)], "cohort string, time double, event int")
    assert [(r.time, round(r.survival, 6)) for r in S.kaplan_meier(df).orderBy("time").collect()] == [(1.0, 0.666667), (2.0, 0.666667), (3.0, 0.0)]


def test_boosted_scores_order_patients(data):
    X, t, e, df = data
    got = {r.sample_id: r.score for r in H.boosted_cox(df, 3, 0.3, 2).collect()}
    conc, tied, comp = c_brute(t, e, np.array([got[str(i)] for i in range(len(t))]))
    assert len(got) == len(t) and (conc + tied / 2) / comp > 0.6


@pytest.mark.parametrize("most", [50, 1000])
def test_a_forest_is_fitted_on_partitions_of_bounded_size(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    rows = [(None if k % 3 else f"s{k}", rng.standard_normal(3).tolist(), float(rng.integers(0, 30)), int(rng.integers(0, 2))) for k in range(400)]
    data = spark.createDataFrame(rows, "sample_id string, vec array<double>, time double, event int").coalesce(2)
    seen = []

    class Forest(H.RandomForestRegressor):
        def fit(self, table):
            seen.append(([r["n"] for r in table.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()], table.count()))
            return super().fit(table)

    monkeypatch.setattr(H, "RandomForestRegressor", Forest)
    monkeypatch.setattr(H, "TREE_ROWS", most, raising=False)
    got = H.survival_forest(data, 3, 2).collect()
    assert sorted((str(r["sample_id"]), r["time"], r["event"]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in rows)
    assert seen[0][1] == 400 and len({r["score"] for r in got}) > 1
    if most == 50:
        assert max(seen[0][0]) <= 60 and len(seen[0][0]) >= 8
