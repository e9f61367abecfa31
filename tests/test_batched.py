"""The batched solver against closed forms, single fits and brute-force recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import batched as B
from cohortia.operators import learn as L
from cohortia.operators import select as S
from cohortia.plans import studies

COLUMNS = "sample_id string, vec array<double>, label int"


def rows_of(seed=1, n=200, d=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.array([1, 5, 0.1, 1, 2][:d]) + np.array([0, 3, 0, 20, 0][:d])
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 1).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(f"s{i:04d}", [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], COLUMNS).repartition(3)


def gradient(x, y, w, b, loss, c, l1_ratio, weight=None):
    """Objective and its smooth gradient from the formula."""
    weight = np.ones(len(y)) if weight is None else weight
    cw = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) * weight
    s = np.where(y == 1, 1.0, -1.0)
    z = x @ w + b
    if loss == "logistic":
        value, slope = np.log1p(np.exp(-s * z)), -s / (1 + np.exp(s * z))
    else:
        short = np.maximum(1 - s * z, 0)
        value, slope = short**2, -2 * s * short
    k = 1 / (c * len(y))
    g = x.T @ (cw * slope) / cw.sum() + k * (1 - l1_ratio) * w
    total = (cw * value).sum() / cw.sum() + k * (l1_ratio * np.abs(w).sum() + (1 - l1_ratio) * (w @ w) / 2)
    return total, g, (cw * slope).sum() / cw.sum(), k * l1_ratio


@pytest.mark.parametrize(("make", "c", "r"), [(L.logreg, 1.0, 0.0), (L.logreg, 0.05, 0.5), (L.logreg, 0.03, 1.0), (L.linear_svm, 0.5, 0.0)])
def test_optimality(spark, make, c, r):
    x, y = rows_of()
    learner = make(c, r) if make is L.logreg else make(c)
    f = L.fit(learner, frame(spark, x, y))
    _, g, gb, one = gradient(x, y, f.coef, f.intercept, learner.linear.loss, c, r)
    on = f.coef != 0
    assert np.allclose(g[on], -one * np.sign(f.coef[on]), atol=2e-5) and np.all(np.abs(g[~on]) <= one + 2e-5) and abs(gb) < 2e-5
    if r == 1.0:
        assert 0 < on.sum() < len(on)
    scored = {q.sample_id: (q.score, q.pred) for q in f.transform(frame(spark, x, y)).collect()}
    assert scored["s0003"][0] == pytest.approx(x[3] @ f.coef + f.intercept) and scored["s0003"][1] == int(scored["s0003"][0] > 0)


def test_group_weights_count(spark):
    x, y = rows_of(2, 90, 3)
    weight = 0.25 + np.arange(90) % 3
    df = frame(spark, x, y).withColumn("group_weight", 0.25 + F.substring("sample_id", 2, 4).cast("int") % 3)
    f = L.fit(L.logreg(0.7), df)
    _, g, gb, _ = gradient(x, y, f.coef, f.intercept, "logistic", 0.7, 0.0, weight)
    assert np.abs(g).max() < 2e-5 and abs(gb) < 2e-5


def test_unsettled_fits_are_errors(spark):
    x, y = rows_of()
    with pytest.raises(B.NotConverged, match="not settled"):
        L.fit(L.logreg(1.0, max_iter=2), frame(spark, x, y))
    with pytest.raises(B.NotConverged):
        L.fit(L.multinomial(1.0, max_iter=2), frame(spark, x, y))
    folds = frame(spark, x, y).withColumn("fold", F.substring("sample_id", 5, 1).cast("int") % 2)
    with pytest.raises(B.NotConverged):
        L.grid_search(folds, lambda C: L.logreg(C, max_iter=2), {"C": [0.1, 1.0]})


def brute_search(x, y, fold, grid, metric):
    """Mean score of every combination by one fit per fold."""
    out = []
    for learner in grid:
        scores = []
        for f in sorted(set(fold)):
            w, b = descend(x[fold != f], y[fold != f], learner.linear)
            scores.append(metric(y[fold == f], x[fold == f] @ w + b))
        out.append(float(np.mean(scores)))
    return out


def descend(x, y, m):
    """A plain proximal gradient method on centred, scaled columns, run for long."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    z, w, b, v, t = (x - mu) / sd, np.zeros(x.shape[1]), 0.0, None, 1.0
    u, ub = w.copy(), b
    rate = 1.0 / (1 + (z**2).sum(axis=1).max() + (1 - m.l1_ratio) / (m.C * len(y) * sd.min() ** 2))
    for _ in range(6000):
        _, g, gb, _ = gradient(z, y, u, ub, m.loss, 1e30, 0.0)
        k = 1 / (m.C * len(y))
        g = g + k * (1 - m.l1_ratio) * u / sd**2
        step = u - rate * g
        new = np.sign(step) * np.maximum(np.abs(step) - rate * k * m.l1_ratio / sd, 0)
        nb = ub - rate * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w / sd, b - (w / sd) @ mu


def auc(y, z):
    p, n = z[y == 1], z[y == 0]
    return ((p[:, None] > n[None, :]).mean() + (p[:, None] == n[None, :]).mean() / 2)


def test_search_equals_single_fits(spark):
    x, y = rows_of(4, 120, 4)
    fold = np.arange(120) % 3
    df = frame(spark, x, y).withColumn("fold", F.substring("sample_id", 2, 4).cast("int") % 3)
    grid = {"C": [0.02, 1.0], "l1_ratio": [0.0, 0.9]}
    table, best, model = L.grid_search(df, L.logreg, grid, ["roc_auc"])
    want = brute_search(x, y, fold, [L.logreg(**c) for c in L.param_grid(grid)], auc)
    got = [r.mean_score for r in table.collect()]
    assert got == pytest.approx(want, abs=1e-9)
    assert best == L.param_grid(grid)[int(np.argmax(np.round(want, 12)))]
    _, g, gb, one = gradient(x, y, model.coef, model.intercept, "logistic", best["C"], best["l1_ratio"])
    assert np.all(np.abs(g) <= one + 2e-5) and abs(gb) < 2e-5


def jobs_of(spark, run):
    """Jobs that ``run`` starts, and what it returns."""
    import uuid

    tag = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(tag, tag)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n, out


def test_jobs_do_not_grow_with_the_grid(spark, monkeypatch):
    x, y = rows_of(5, 120, 3)
    df = frame(spark, x, y).withColumn("fold", F.substring("sample_id", 2, 4).cast("int") % 4).persist()
    passes = []
    close = B.Problem.close
    monkeypatch.setattr(B.Problem, "close", lambda self: (passes.append(self.passes), close(self))[1])
    few, _ = jobs_of(spark, lambda: L.grid_search(df, L.logreg, {"C": [1.0]}))
    few_passes = sum(passes)
    passes.clear()
    many, _ = jobs_of(spark, lambda: L.grid_search(df, L.logreg, {"C": [0.01, 0.03, 0.1, 0.3, 1.0], "l1_ratio": [0.0, 0.5, 1.0]}))
    assert abs((many - sum(passes)) - (few - few_passes)) <= 3  # besides the passes nothing is added
    assert sum(passes) < 6 * few_passes  # 60 fits instead of 4: as many passes as the slowest column needs
    df.unpersist()


def test_many_columns_in_several_matrices(spark, monkeypatch):
    x, y = rows_of(6, 80, 3)
    df = frame(spark, x, y).withColumn("fold", F.substring("sample_id", 2, 4).cast("int") % 2)
    whole = [r.mean_score for r in L.grid_search(df, L.logreg, {"C": [0.1, 1.0, 10.0]})[0].collect()]
    monkeypatch.setattr(B, "MATRIX_BYTES", 2 * 8 * 4)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    monkeypatch.setattr(B, "CHUNK", 3)
    monkeypatch.setattr(B, "BLOCK_CELLS", 1)
    assert [r.mean_score for r in L.grid_search(df, L.logreg, {"C": [0.1, 1.0, 10.0]})[0].collect()] == pytest.approx(whole, abs=1e-6)


def test_nested_study_equals_its_parts(spark):
    """One solve for all splits gives what scaling, selecting, searching and refitting each split apart gives."""
    x, y = rows_of(7, 96, 5)
    df = frame(spark, x, y)
    ids = list("abcde")
    outer = studies.outer_splits(df.select("sample_id", "label"), 3, 1, False)
    t = L.nested_cv(df, ids, L.logreg, {"C": [0.05, 2.0]}, outer, 2, ["roc_auc", "balanced_accuracy"], S.k_best_selector(3), inner_repeats=2)
    part = {}
    for r in outer.collect():
        part.setdefault(r.split, {})[r.sample_id] = r.part
    weights = {}
    for r in t.split_feature_weights.collect():
        weights.setdefault(r.split, {})[r.feature_id] = r.weight
    scores = {r.split: r.value for r in t.split_scores.where("metric = 'roc_auc'").collect()}
    preds = {(r.split, r.sample_id): r.score for r in t.predictions.collect()}
    log = {}
    for r in t.cv_results.where("metric = 'roc_auc'").collect():
        log.setdefault(r.split, []).append((r.mean_score, float(r.params["C"])))
    name = np.array([f"s{i:04d}" for i in range(96)])
    for s in range(3):
        train = np.array([part[s][k] == "train" for k in name])
        mu, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - mu) / sd
        keep = sorted(ids.index(f) for f in weights[s])
        assert len(keep) == 3
        c = max(log[s], key=lambda v: (round(v[0], 12), -v[1]))[1]
        w, b = descend(z[train][:, keep], y[train], L.logreg(c).linear)
        assert [weights[s][ids[k]] for k in keep] == pytest.approx(list(w), abs=2e-4)
        test = ~train
        assert scores[s] == pytest.approx(auc(y[test], z[test][:, keep] @ w + b), abs=1e-6)
        assert all(preds[s, k] == pytest.approx(v, abs=2e-3) for k, v in zip(name[test], z[test][:, keep] @ w + b))
        folds = L._inner_folds(df.join(outer.where((F.col("split") == s) & (F.col("part") == "train")).drop("part"), "sample_id"), 2, 2, 777, ["split"])
        fold = {}
        for r in folds.select("sample_id", "repeat", "fold").collect():
            fold.setdefault(r.repeat, {})[r.sample_id] = r.fold
        for k, cc in enumerate([0.05, 2.0]):
            each = []
            for r in fold:
                f = np.array([fold[r].get(q, -1) for q in name])
                for held in (0, 1):
                    fit, out = train & (f != held), f == held
                    w, b = descend(z[fit][:, keep], y[fit], L.logreg(cc).linear)
                    each.append(auc(y[out], z[out][:, keep] @ w + b))
            assert log[s][k][0] == pytest.approx(np.mean(each), abs=1e-3)


def _brute_permutations(spark, x, y, ids, cells, learners, k):
    """Mean test score per permutation, every split fitted by itself on rows scaled by its own training rows."""
    at, out = {s: i for i, s in enumerate(ids)}, {}
    for r in cells:
        out.setdefault(r.perm, []).append((at[r.sample_id], r.repeat, r.fold, r.label))
    means = {}
    for perm, rows in out.items():
        scores = []
        for s, m in learners.items():
            of = [r for r in rows if r[1] == s // k]
            tr, te = ([r for r in of if (r[2] == s % k) == held] for held in (False, True))
            i, j = [r[0] for r in tr], [r[0] for r in te]
            mu, sd = x[i].mean(axis=0), x[i].std(axis=0)
            w, b = descend((x[i] - mu) / sd, np.array([r[3] for r in tr]), m.linear)
            label = np.array([r[3] for r in te])
            if 0 < label.sum() < len(label):
                scores.append(auc(label, (x[j] - mu) / sd @ w + b))
        means[perm] = np.mean(scores)
    return means


@pytest.mark.parametrize("grouped", [False, True])
def test_refit_permutation_equals_single_fits(spark, grouped, monkeypatch):
    x, y = rows_of(5, 48, 3)
    vecs = frame(spark, x, y)
    if grouped:  # pairs and threes share a group
        vecs = vecs.withColumn("group_id", F.concat(F.lit("g"), (F.substring("sample_id", 2, 4).cast("int") * 2 / 5).cast("int").cast("string")))
    k, repeats, n = 3, 2, 7
    learners = {s: L.logreg(0.5 if s % 2 else 0.05) for s in range(k * repeats)}
    monkeypatch.setattr(B, "MATRIX_BYTES", 3 * 8 * 4 * 6 * 3)  # three permutations a turn
    summary, perms = L.refit_permutation(vecs, learners, k, repeats, 0.6, n, seed=3)
    from cohortia.operators.splits import permute_labels

    drawn = permute_labels(vecs.select("sample_id", "label", *(["group_id"] if grouped else [])), n, "group_id" if grouped else None, 3)
    cells = L._inner_folds(drawn, k, repeats, 3, ["perm"]).collect()
    if grouped:  # labels stay inside their group
        count = lambda rows: sorted((r[0], r[1]) for r in rows)
        before = count(vecs.groupBy("group_id").agg(F.sum("label")).collect())
        assert all(count(drawn.where(F.col("perm") == p).groupBy("group_id").agg(F.sum("label")).collect()) == before for p in range(2))
    brute = _brute_permutations(spark, x, y, [f"s{i:04d}" for i in range(48)], cells, learners, k)
    got = {r.perm: r.value for r in perms.collect()}
    assert got.keys() == brute.keys() and all(got[p] == pytest.approx(brute[p], abs=1e-9) for p in got)
    s = summary.first()
    assert s.p == (sum(v >= 0.6 - 1e-12 for v in brute.values()) + 1) / (n + 1) and s.mean_permuted == pytest.approx(np.mean(list(brute.values())))


def test_refit_permutation_finds_signal_and_none(spark):
    x, y = rows_of(6, 60, 3)
    real, _ = L.refit_permutation(frame(spark, x, y), {s: L.logreg(1.0) for s in range(3)}, 3, 1, 0.9, 40)
    assert real.first().p == pytest.approx(1 / 41) and 0.35 < real.first().mean_permuted < 0.65
    empty, _ = L.refit_permutation(frame(spark, x, y), {0: L.logreg(1.0)}, 3, 1, None, 3)
    assert empty.first().p is None
    with pytest.raises(ValueError, match="linear learner"):
        L.refit_permutation(frame(spark, x, y), {0: L.random_forest(2, 2)}, 3, 1, 0.5, 3)


def test_logistic_loss_makes_few_arrays():
    """The loss of all cells of a block is most of a pass: it is worked out in place, and as before."""
    import tracemalloc

    rng = np.random.default_rng(6)
    z, y = 30 * rng.normal(size=(1000, 500)), np.where(rng.random((1000, 500)) < 0.5, 1.0, -1.0)
    z[0, :3] = 0.0, 800.0, -800.0
    tracemalloc.start()
    value, slope = B.logistic(z, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    m, e = z * y, np.exp(-np.abs(z * y))
    assert (value == np.maximum(-m, 0) + np.log1p(e)).all() and (slope == -y * np.where(m >= 0, e, 1.0) / (1 + e)).all()
    assert peak <= 5.05 * z.nbytes
