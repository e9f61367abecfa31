"""Learners on dense vectors, grid search and nested cross-validation.

Input rows are (sample_id, vec ARRAY<DOUBLE>, label). Linear models are solved by ``batched``: all
combinations, folds and outer splits of a search at once. The others are Spark ML estimators; every
fit is a distributed job, and a small thread pool keeps several fits in flight. Predictions of
all fits go to one table, so the metrics of a whole search are one query. A fit that does not
settle within its steps is an error.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortia.operators import batched as B
from cohortia.operators import components as C
from cohortia.operators import metrics as M
from cohortia.session import cut_lineage, shared_dir, written

PARALLEL_FITS = 4


@dataclass(frozen=True)
class Linear:
    """What ``batched`` needs to know of a linear model."""

    loss: str
    C: float
    l1_ratio: float = 0.0
    max_iter: int = 500


@dataclass(frozen=True)
class Learner:
    """A named model: ``linear`` if ``batched`` solves it, else ``make(n_rows)`` builds the Spark estimator."""

    name: str
    make: Callable[[int], Estimator] | None = None
    balanced: bool = True
    prepare: Callable[[DataFrame], DataFrame] | None = None
    linear: Linear | None = None


@dataclass(frozen=True)
class LinearFitted:
    """A solved linear model; the score is the margin."""

    learner: Learner
    coef: np.ndarray
    intercept: float

    def transform(self, vecs: DataFrame) -> DataFrame:
        coef, intercept = self.coef, self.intercept

        @F.pandas_udf(DoubleType())
        def margin(v: pd.Series) -> pd.Series:
            return pd.Series(np.stack(v.to_numpy()) @ coef + intercept if len(v) else [], dtype=float)

        df = self.learner.prepare(vecs) if self.learner.prepare else vecs
        kept = [c for c in ("group_weight",) if c in vecs.columns]
        return df.select("sample_id", "label", *kept, margin("vec").alias("score")).withColumn("pred", (F.col("score") > 0).cast("int"))

    def weights(self) -> np.ndarray:
        return self.coef


@dataclass(frozen=True)
class Fitted:
    learner: Learner
    model: Model

    def transform(self, vecs: DataFrame) -> DataFrame:
        """(sample_id, label, score, pred); score is the margin, or the probability for forests."""
        data = _assemble(vecs, self.learner)
        out = self.model.transform(data)
        raw = "probability" if self.learner.name.startswith(("random_forest", "gradient_boosting", "multinomial")) else "rawPrediction"
        kept = [c for c in ("group_weight",) if c in out.columns]
        return out.select("sample_id", "label", *kept, vector_to_array(raw)[1].alias("score"), F.col("prediction").cast("int").alias("pred"))

    def weights(self) -> np.ndarray:
        m = self.model
        if hasattr(m, "featureImportances"):
            return m.featureImportances.toArray()
        if getattr(m, "numClasses", 2) > 2:
            return np.abs(m.coefficientMatrix.toArray()).sum(axis=0)
        return m.coefficients.toArray()


def _assemble(vecs: DataFrame, learner: Learner) -> DataFrame:
    df = learner.prepare(vecs) if learner.prepare else vecs
    return df.withColumn("features", array_to_vector("vec"))


def class_weights(vecs: DataFrame) -> tuple[dict[int, float], int]:
    """Balanced weight n / (k n_c) per class, and n; one row per class reaches the driver."""
    counts = {r["label"]: r["count"] for r in vecs.groupBy("label").count().collect()}
    n = sum(counts.values())
    return {c: n / (len(counts) * m) for c, m in counts.items()}, n


def _rows(vecs: DataFrame, folds, *more: str) -> DataFrame:
    """Rows as ``batched`` reads them; replicates share the weight of their group."""
    weight = F.coalesce(F.col("group_weight").cast("double"), F.lit(1.0)) if "group_weight" in vecs.columns else F.lit(1.0)
    return vecs.select("sample_id", "vec", "label", weight.alias("weight"), folds.cast("array<int>").alias("folds"), *more)


def fit(learner: Learner, vecs: DataFrame) -> Fitted | LinearFitted:
    if learner.linear:
        m = learner.linear
        df = learner.prepare(vecs) if learner.prepare else vecs
        problem = B.Problem(_rows(df, F.array(F.lit(0))), m.loss, learner.balanced)
        try:
            fits = B.Fits.of([(0, B.TEST, m.C, m.l1_ratio)])
            if not problem.fittable(fits).all():
                raise ValueError("training rows hold a single class")
            w, b = problem.original(*B.solve(problem, fits, m.max_iter))
        finally:
            problem.close()
        return LinearFitted(learner, w[:, 0], float(b[0]))
    weights, n = class_weights(vecs)
    if len(weights) < 2:
        raise ValueError("training rows hold a single class")
    w = F.lit(1.0)
    for c, v in weights.items():
        w = F.when(F.col("label") == c, F.lit(v if learner.balanced else 1.0)).otherwise(w)
    if "group_weight" in vecs.columns:  # replicates share the weight of their group
        w = w * F.coalesce(F.col("group_weight").cast("double"), F.lit(1.0))
    data = _assemble(vecs, learner).withColumn("weight", w)
    estimator = learner.make(n)
    model = estimator.fit(data)
    if isinstance(estimator, LogisticRegression) and model.summary.totalIterations >= estimator.getMaxIter():
        raise B.NotConverged(f"{learner.name} has not settled after {estimator.getMaxIter()} steps")
    return Fitted(learner, model)


def logreg(C: float = 1.0, l1_ratio: float = 0.0, balanced: bool = True, max_iter: int = 500) -> Learner:
    """Logistic regression with an L2 and an L1 part; C weighs the summed loss against them."""
    return Learner("logreg", balanced=balanced, linear=Linear("logistic", C, l1_ratio, max_iter))


def multinomial(C: float = 1.0, max_iter: int = 500) -> Learner:
    return Learner("multinomial", lambda n: LogisticRegression(
        regParam=1.0 / (C * n), family="multinomial", weightCol="weight", standardization=False, maxIter=max_iter), False)


def linear_svm(C: float = 1.0, balanced: bool = True, max_iter: int = 500) -> Learner:
    """Linear support vector machine with the squared hinge, whose optimum is unique."""
    return Learner("linear_svm", balanced=balanced, linear=Linear("squared_hinge", C, 0.0, max_iter))


def random_fourier(gamma: float, n_features: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Map vec to cosine features whose inner product approximates exp(-gamma |x - y|^2) (Rahimi & Recht 2007)."""

    def prepare(vecs: DataFrame) -> DataFrame:
        drawn = []

        @F.pandas_udf(ArrayType(DoubleType()))
        def project(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            X = np.stack(v.to_numpy())
            if not drawn:  # once per worker
                rng = np.random.default_rng(seed)
                drawn.extend((rng.normal(scale=np.sqrt(2 * gamma), size=(X.shape[1], n_features)), rng.uniform(0, 2 * np.pi, n_features)))
            return pd.Series(list(np.sqrt(2.0 / n_features) * np.cos(X @ drawn[0] + drawn[1])))

        return vecs.withColumn("vec", project("vec"))

    return prepare


def kernel_svm(C: float = 1.0, gamma: float = 0.1, n_features: int = 200, seed: int = 42) -> Learner:
    """RBF support vector machine as random Fourier features under a linear one."""
    return Learner("kernel_svm", prepare=random_fourier(gamma, n_features, seed), linear=linear_svm(C).linear)


def random_forest(trees: int = 100, depth: int = 5, seed: int = 42, balanced: bool = True) -> Learner:
    return Learner("random_forest", lambda n: RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed), balanced)


def gradient_boosting(trees: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42) -> Learner:
    return Learner("gradient_boosting", lambda n: GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, weightCol="weight", seed=seed), True)


LEARNERS: dict[str, Callable[..., Learner]] = {
    "logreg": logreg, "multinomial": multinomial, "linear_svm": linear_svm, "kernel_svm": kernel_svm,
    "random_forest": random_forest, "gradient_boosting": gradient_boosting,
}


def model_weights(fitted: Fitted, feature_ids: Sequence[str], vecs: DataFrame) -> DataFrame:
    """(feature_id, weight) without zeros; the model itself is already feature-sized on the driver."""
    rows = [(f, float(w)) for f, w in zip(feature_ids, fitted.weights()) if w != 0]
    return vecs.sparkSession.createDataFrame(rows, "feature_id string, weight double")


# --- vector preparation ------------------------------------------------------------------


def vector_moments(vecs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std per dimension in one pass; zero std counts as 1."""
    r = vecs.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("vec")).alias("s")).select("s.*").first()
    n = r["count"]
    std = np.sqrt(r["variance"].toArray() * (n - 1) / n) if n > 1 else np.zeros(len(r["mean"]))
    return r["mean"].toArray(), np.where(std > 0, std, 1.0)


def scale_vectors(vecs: DataFrame, mean: np.ndarray, std: np.ndarray, keep: Sequence[int] | None = None) -> DataFrame:
    """(vec - mean) / std, optionally restricted to some dimensions, in Arrow batches."""
    idx = np.arange(len(mean)) if keep is None else np.asarray(list(keep), dtype=int)

    @F.pandas_udf(ArrayType(DoubleType()))
    def scale(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(((np.stack(v.to_numpy()) - mean) / std)[:, idx]))

    return vecs.withColumn("vec", scale("vec"))


# --- search ------------------------------------------------------------------------------

METRICS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "roc_auc": M.roc_auc, "balanced_accuracy": M.balanced_accuracy, "average_precision": M.average_precision, "accuracy": M.accuracy}


def param_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    keys = list(grid)
    return [dict(zip(keys, v)) for v in itertools.product(*grid.values())]


def _score_table(preds: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    out = None
    for m in metrics:
        t = METRICS[m](preds, by).select(*by, F.lit(m).alias("metric"), F.col(m).alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


def _classes(rows: DataFrame, by: Sequence[str]) -> dict[tuple, set]:
    """Labels per fold; one row per fold and class reaches the driver."""
    out: dict[tuple, set] = {}
    for r in rows.select(*by, "label").distinct().collect():
        out.setdefault(tuple(r[c] for c in by), set()).add(r["label"])
    return out


def _ranked(spark, combos: Sequence[dict], scores: Mapping[tuple[int, str], list[float]], metrics: Sequence[str], refit: str) -> tuple[list[tuple], int]:
    """The search log and the best combination: largest mean of ``refit``, the first of equals, or of all if none has a score."""
    table, mean = [], {}
    for i, params in enumerate(combos):
        for m in metrics:
            vals = scores.get((i, m))
            mean[(i, m)] = float(np.mean(vals)) if vals else None
            table.append(({k: str(v) for k, v in params.items()}, m, mean[(i, m)], float(np.std(vals)) if vals else None))
    scored = [i for i in range(len(combos)) if mean[(i, refit)] is not None]
    return table, max(scored, key=lambda i: (mean[(i, refit)], -i)) if scored else 0


CV_RESULTS = "params map<string,string>, metric string, mean_score double, std_score double"


def _all_linear(learners: Sequence[Learner]) -> bool:
    """May these be solved together: one loss, no mapping of the vectors?"""
    same = {(m.linear.loss, m.balanced) for m in learners if m.linear and not m.prepare}
    return len(same) == 1 and all(m.linear and not m.prepare for m in learners)


def _inner_scores(problem: B.Problem, learners: Sequence[Learner], places: Sequence[tuple[int, int]], metrics: Sequence[str]) -> dict[tuple[int, int, str], float]:
    """Score per (place, combination, metric); a place is a slot and the fold it leaves out. All fits in one solve."""
    jobs = [(p, i) for p in range(len(places)) for i in range(len(learners))]
    fits = B.Fits.of([(*places[p], learners[i].linear.C, learners[i].linear.l1_ratio) for p, i in jobs])
    able = np.flatnonzero(problem.fittable(fits))
    if not len(able):
        return {}
    fits = fits.take(able)
    w, b = B.solve(problem, fits, max(m.linear.max_iter for m in learners))
    preds = problem.scores(fits, w, b).drop("weight")
    out = {}
    for r in _score_table(preds, ["fit"], metrics).collect():
        if r["value"] is not None:
            p, i = jobs[able[r["fit"]]]
            out[(p, i, r["metric"])] = r["value"]
    return out


def _search_linear(vecs: DataFrame, learners: Sequence[Learner], combos: Sequence[dict], metrics: Sequence[str], refit: str, fold_col: str, repeat_col: str | None) -> tuple[list[tuple], int]:
    values = sorted(r[0] for r in vecs.select(fold_col).distinct().collect())
    fold = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(fold_col)).cast("int") - 1
    if repeat_col is None:
        rows, slots = _rows(vecs, F.array(fold)), 1
    else:  # every row once, with its fold of every repeat
        repeats = sorted(r[0] for r in vecs.select(repeat_col).distinct().collect())
        slots = len(repeats)
        own = [c for c in ("vec", "label", "group_weight") if c in vecs.columns]
        at = F.map_from_entries(F.collect_list(F.struct(F.col(repeat_col), fold)))
        once = vecs.groupBy("sample_id").agg(*[F.first(c).alias(c) for c in own], at.alias("at"))
        rows = _rows(once, F.array(*[F.coalesce(F.try_element_at("at", F.lit(r)), F.lit(B.ABSENT)) for r in repeats]))
    m = learners[0]
    problem = B.Problem(rows, m.linear.loss, m.balanced)
    try:
        places = [(s, f) for s in range(slots) for f in range(len(values))]
        got = _inner_scores(problem, learners, places, metrics)
    finally:
        problem.close()
    scores: dict[tuple, list[float]] = {}
    for (_, i, name), v in sorted(got.items()):
        scores.setdefault((i, name), []).append(v)
    return _ranked(vecs.sparkSession, combos, scores, metrics, refit)


def grid_search(
    vecs: DataFrame, learner: Callable[..., Learner], grid: Mapping[str, Sequence], metrics: Sequence[str] = ("roc_auc", "balanced_accuracy"),
    refit: str | None = None, fold_col: str = "fold", repeat_col: str | None = None,
) -> tuple[DataFrame, dict, Fitted | LinearFitted]:
    """All parameter combinations on all folds -> (cv_results, best parameters, refitted model).

    ``vecs`` carries ``fold_col`` and, for repeated folds, ``repeat_col`` with every row once per
    repeat. Linear models of one loss are solved all at once; for others each fit writes its held-out
    predictions to the shared folder. A fold whose training
    part holds one class cannot be fitted and one whose test part does has no score: it counts in no
    mean, and a combination without any score has a null one; if none has a score the first is
    taken. Every other failure ends the search.
    """
    spark, refit = vecs.sparkSession, refit or metrics[0]
    combos = param_grid(grid)
    learners = [learner(**c) for c in combos]
    if _all_linear(learners):
        table, best = _search_linear(vecs, learners, combos, metrics, refit, fold_col, repeat_col)
    else:
        table, best = _search_single(vecs, learners, combos, metrics, refit, fold_col, repeat_col)
    whole = vecs
    if repeat_col:
        whole = vecs.where(F.col(repeat_col) == vecs.agg(F.min(repeat_col)).first()[0])
    return spark.createDataFrame(table, CV_RESULTS), combos[best], fit(learners[best], whole)


def _search_single(vecs: DataFrame, learners: Sequence[Learner], combos: Sequence[dict], metrics: Sequence[str], refit: str, fold_col: str, repeat_col: str | None) -> tuple[list[tuple], int]:
    """A fit of its own for every combination and fold."""
    spark = vecs.sparkSession
    cols = [*([repeat_col] if repeat_col else []), fold_col]
    classes = _classes(vecs, cols)
    folds = sorted(classes)
    inside = lambda f: (F.col(repeat_col) == f[0]) if repeat_col else F.lit(True)
    base = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"

    def fits(f: tuple) -> bool:
        rest = [classes[g] for g in folds if g[-1] != f[-1] and g[:-1] == f[:-1]]
        return len(set().union(*rest)) > 1 if rest else False

    def one(job: tuple[int, int]) -> None:
        i, k = job
        f = folds[k]
        fitted = fit(learners[i], vecs.where(inside(f) & (F.col(fold_col) != f[-1])))
        fitted.transform(vecs.where(inside(f) & (F.col(fold_col) == f[-1]))).write.parquet(f"{base}/combo={i}/fold={k}")

    jobs = [(i, k) for i in range(len(combos)) for k, f in enumerate(folds) if fits(f)]
    with ThreadPool(PARALLEL_FITS) as pool:
        pool.map(inheritable_thread_target(spark)(one), jobs)
    scores: dict[tuple, list[float]] = {}
    if jobs:
        preds = spark.read.option("basePath", base).parquet(*[f"{base}/combo={i}/fold={k}" for i, k in jobs])
        for r in _score_table(preds, ["combo", "fold"], metrics).collect():
            if r["value"] is not None:
                scores.setdefault((r["combo"], r["metric"]), []).append(r["value"])
    return _ranked(spark, combos, scores, metrics, refit)


@dataclass
class StudyTables:
    """What a nested cross-validation leaves behind, one row set per logical table."""

    predictions: DataFrame
    split_scores: DataFrame
    cv_results: DataFrame
    split_feature_weights: DataFrame
    failures: list[str] = field(default_factory=list)
    chosen: dict[int, dict] = field(default_factory=dict)  # outer split -> parameters of its refit


Selector = Callable[[DataFrame, Sequence[str]], Sequence[int]]


def nested_cv(
    vecs: DataFrame, feature_ids: Sequence[str], learner: Callable[..., Learner], grid: Mapping[str, Sequence], outer: DataFrame,
    inner_k: int = 3, metrics: Sequence[str] = ("roc_auc", "balanced_accuracy", "average_precision"), selector: Selector | None = None, model: str = "model", seed: int = 777,
    inner_repeats: int = 5,
) -> StudyTables:
    """Outer splits (sample_id, split, part in train/test): scale and select on train, search, refit, test.

    With a ``group_id`` column the inner folds keep groups whole; a ``group_weight`` column
    weighs training rows and test scores. An outer split whose training rows hold one class is
    listed in ``failures`` and has null scores; any other failure ends the study.
    """
    spark = vecs.sparkSession
    extra = [c for c in ("group_id", "group_weight") if c in vecs.columns]
    classes = _classes(vecs.select("sample_id", "label").join(outer.where("part = 'train'"), "sample_id"), ["split"])
    splits = sorted(r[0] for r in outer.select("split").distinct().collect())
    done = [s for s in splits if len(classes.get((s,), ())) > 1]
    failures = [f"split {s}: training rows hold a single class" for s in splits if s not in done]
    if not done:
        raise ValueError("no outer split holds both classes in its training rows")
    combos = param_grid(grid)
    learners = [learner(**c) for c in combos]
    run = _nested_linear if _all_linear(learners) else _nested_single
    preds, weights, cv, chosen = run(vecs, feature_ids, learner, learners, grid, outer, done, inner_k, metrics, selector, seed, inner_repeats, extra)
    name, data = F.lit(model).alias("model"), F.lit("all").alias("dataset")
    weight = F.coalesce(F.col("group_weight").cast("double"), F.lit(1.0)) if "group_weight" in preds.columns else F.lit(1.0)
    preds = preds.select(name, data, "split", "sample_id", "label", "score", "pred", weight.alias("weight"))
    weights = weights.select(name, data, "split", "feature_id", "weight")
    scores = _score_table(preds, ["model", "dataset", "split"], metrics).withColumn("stage", F.lit("te"))
    if failures:
        lost = [(model, "all", int(s), m, None, "te") for s in splits if s not in done for m in metrics]
        scores = scores.unionByName(spark.createDataFrame(lost, "model string, dataset string, split int, metric string, value double, stage string"))
    return StudyTables(preds, scores, cv.withColumn("model", F.lit(model)), weights, failures, chosen)


def _inner_folds(rows: DataFrame, k: int, repeats: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Repeated stratified folds of training rows, of each split in ``by`` apart; groups stay whole if there are any."""
    from cohortia.operators.splits import fold_assign, repeated_stratified_group_kfold

    if "group_id" in rows.columns:
        return repeated_stratified_group_kfold(rows, k, repeats, seed, by)
    return fold_assign(rows, k, [*by, "label"], repeats, seed)


def _nested_linear(vecs, feature_ids, learner, learners, grid, outer, done, inner_k, metrics, selector, seed, inner_repeats, extra) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, dict]]:
    """Predictions, weights and search log of all splits: one solve for all inner fits, one for the refits.

    A slot is a repeat of an outer split; its test rows wait in the first one.
    """
    spark, combos = vecs.sparkSession, param_grid(grid)
    place = F.array_position(F.array(*[F.lit(s) for s in done]), F.col("split")).cast("int") - 1
    parts = outer.where(F.col("split").isin(done)).select("sample_id", place.alias("split"), "part")
    cols = ["sample_id", "label", *[c for c in extra if c == "group_id"]]
    train = vecs.select(*cols).join(parts.where("part = 'train'").drop("part"), "sample_id")
    folds = _inner_folds(train, inner_k, inner_repeats, seed, ["split"])
    cells = folds.select("sample_id", (F.col("split") * inner_repeats + F.col("repeat")).alias("slot"), "fold")
    tests = parts.where("part = 'test'").select("sample_id", (F.col("split") * inner_repeats).alias("slot"), F.lit(B.TEST).alias("fold"))
    slots = len(done) * inner_repeats
    per = cells.unionByName(tests).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "fold"))).alias("at"))
    at = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.coalesce(F.try_element_at("at", s), F.lit(B.ABSENT)))
    rows = cut_lineage(_rows(vecs.join(per, "sample_id"), at))
    keep = {}
    if selector:
        for u, s in enumerate(done):
            part = vecs.join(outer.where((F.col("split") == s) & (F.col("part") == "train")).select("sample_id"), "sample_id")
            keep[u] = list(selector(scale_vectors(part, *vector_moments(part)), feature_ids))
    m = learners[0]
    problem = B.Problem(rows, m.linear.loss, m.balanced, np.repeat(np.arange(len(done)), inner_repeats), True, keep)
    try:
        places = [(s, f) for s in range(slots) for f in range(inner_k)]
        got = _inner_scores(problem, learners, places, metrics)
        log, best, chosen = [], [], {}
        for u, s in enumerate(done):
            scores: dict[tuple, list[float]] = {}
            for (p, i, name), v in sorted(got.items()):
                if places[p][0] // inner_repeats == u:
                    scores.setdefault((i, name), []).append(v)
            table, b = _ranked(spark, combos, scores, metrics, metrics[0])
            log += [(*t, int(s)) for t in table]
            best.append(learners[b].linear)
            chosen[int(s)] = combos[b]
        fits = B.Fits.of([(u * inner_repeats, B.TEST, x.C, x.l1_ratio) for u, x in enumerate(best)])
        w, b = B.solve(problem, fits, max(x.max_iter for x in best))
        kind = dict(vecs.dtypes)
        scored = problem.scores(fits, w, b, f"sample_id {kind['sample_id']}, label int, weight double")
        split = F.element_at(F.array(*[F.lit(int(s)) for s in done]), F.col("fit") + 1)
        w, _ = problem.seen(fits, w, b)
        preds = cut_lineage(scored.select(split.alias("split"), "sample_id", F.col("label").cast(kind["label"]).alias("label"), "score", "pred", F.col("weight").alias("group_weight")))
    finally:
        problem.close()
    named = [(int(s), f, float(w[i, u])) for u, s in enumerate(done) for i, f in enumerate(feature_ids) if w[i, u] != 0]
    weights = spark.createDataFrame(named, "split int, feature_id string, weight double")
    return preds, weights, spark.createDataFrame(log, f"{CV_RESULTS}, split int"), chosen


def _nested_single(vecs, feature_ids, learner, learners, grid, outer, done, inner_k, metrics, selector, seed, inner_repeats, extra) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, dict]]:
    """The same for models that are fitted one by one."""
    spark = vecs.sparkSession
    base = f"{shared_dir(spark)}/study-{uuid.uuid4().hex}"
    cv_parts, chosen = None, {}
    for s in done:
        part = vecs.join(outer.where(F.col("split") == s).select("sample_id", "part"), "sample_id")
        train = part.where("part = 'train'")
        mean, std = vector_moments(train)
        scaled = scale_vectors(train, mean, std)
        keep = list(selector(scaled, feature_ids)) if selector else list(range(len(feature_ids)))
        chosen = scale_vectors(train, mean, std, keep).select("sample_id", "vec", "label", *extra)
        folds = _inner_folds(chosen, inner_k, inner_repeats, seed).persist()
        cv, chosen[int(s)], fitted = grid_search(folds, learner, grid, metrics, repeat_col="repeat")
        test = scale_vectors(part.where("part = 'test'").select("sample_id", "vec", "label", *extra), mean, std, keep)
        fitted.transform(test).withColumn("split", F.lit(int(s))).write.parquet(f"{base}/predictions/s={s}")
        model_weights(fitted, [feature_ids[i] for i in keep], vecs).withColumn("split", F.lit(int(s))).coalesce(1).write.parquet(f"{base}/weights/s={s}")
        cv = cv.withColumn("split", F.lit(int(s)))
        cv_parts = cv if cv_parts is None else cv_parts.unionByName(cv)
        folds.unpersist()
    preds = spark.read.parquet(*[f"{base}/predictions/s={s}" for s in done])
    weights = spark.read.parquet(*[f"{base}/weights/s={s}" for s in done])
    return preds, weights, cv_parts, chosen


def refit_permutation(
    vecs: DataFrame, learners: Mapping[int, Learner], k: int, repeats: int, true: float | None, n: int = 1000, metric: str = "roc_auc", seed: int = 777,
) -> tuple[DataFrame, DataFrame]:
    """Permutation test of a cross-validated score with every model fitted anew -> ((true, mean_permuted, p), (perm, value)).

    ``learners`` maps an outer split (repeat x k + fold) to the linear learner chosen there. Labels are permuted
    among all samples, or inside each ``group_id`` if there is one; each permutation gets stratified folds of its
    own labels, its training rows are scaled, weighted and fitted and its test rows scored, and its value is the
    mean over the splits, as ``true`` is. A split whose training or test rows hold one class counts in no mean, a permutation
    without any score in no p. p = (#{value >= true} + 1) / (N + 1); null if ``true`` is.

    All splits of as many permutations as fit a coefficient matrix are one solve. A row carries a fold and a label per
    (permutation, split) of a turn only.
    """
    from cohortia.operators.splits import permute_labels

    spark, splits = vecs.sparkSession, sorted(learners)
    if not splits or not _all_linear([learners[s] for s in splits]):
        raise ValueError("refits need a linear learner for every split")
    m = learners[splits[0]]
    extra = [c for c in ("group_id",) if c in vecs.columns]
    drawn = permute_labels(vecs.select("sample_id", "label", *extra), n, extra[0] if extra else None, seed)
    cells = cut_lineage(_inner_folds(drawn, k, repeats, seed, ["perm"]).select("sample_id", "perm", "repeat", "fold", F.col("label").cast("int").alias("label")))
    d = vecs.select(F.size("vec")).first()[0]
    turn = max(1, B.MATRIX_BYTES // (3 * 8 * (d + 1) * len(splits)))
    kind, values = dict(vecs.dtypes)["sample_id"], []
    for lo in range(0, n, turn):
        perms = min(turn, n - lo)
        mine = cells.where(F.col("perm").between(lo, lo + perms - 1))
        at = F.map_from_entries(F.collect_list(F.struct(((F.col("perm") - lo) * repeats + F.col("repeat")).alias("slot"), F.struct("fold", "label").alias("c"))))
        per = mine.groupBy("sample_id").agg(at.alias("at"))
        slots = F.sequence(F.lit(0), F.lit(perms * len(splits) - 1))
        split = F.array(*[F.lit(int(s)) for s in splits])

        def cell(s: Column) -> tuple[Column, Column]:
            of = F.get(split, (s % len(splits)).cast("int"))
            return F.try_element_at("at", (F.floor(s / len(splits)) * repeats + F.floor(of / k)).cast("int")), of % k

        def fold(s: Column) -> Column:
            c, f = cell(s)
            return F.when(c["fold"] == f, B.TEST).when(c.isNotNull(), 0).otherwise(B.ABSENT)

        labels = F.transform(slots, lambda s: F.coalesce(cell(s)[0]["label"], F.lit(0)))
        joined = vecs.join(per, "sample_id").withColumn("labels", labels.cast("array<int>"))
        rows = cut_lineage(_rows(joined, F.transform(slots, fold), "labels"))
        problem = B.Problem(rows, m.linear.loss, m.balanced, range(perms * len(splits)), True)
        try:
            models = [learners[s].linear for s in splits] * perms
            fits = B.Fits.of([(i, B.TEST, x.C, x.l1_ratio) for i, x in enumerate(models)])
            able = np.flatnonzero(problem.fittable(fits))
            if not len(able):
                continue
            fits = fits.take(able)
            w, b = B.solve(problem, fits, max(x.max_iter for x in models))
            preds = problem.scores(fits, w, b, f"sample_id {kind}, label int, weight double")
            got: dict[int, list[float]] = {}
            for r in sorted(_score_table(preds, ["fit"], [metric]).collect(), key=lambda r: r["fit"]):  # one number a fit
                if r["value"] is not None:
                    got.setdefault(lo + int(able[r["fit"]]) // len(splits), []).append(r["value"])
            values += [(p, float(np.mean(v))) for p, v in sorted(got.items())]
        finally:
            problem.close()
    perms = spark.createDataFrame(values, "perm int, value double")
    hits = sum(v >= true - 1e-12 for _, v in values) if true is not None else 0
    p = (hits + 1) / (len(values) + 1) if true is not None else None
    mean = float(np.mean([v for _, v in values])) if values else None
    return spark.createDataFrame([(true, mean, p)], "true double, mean_permuted double, p double"), perms


# --- latent representations --------------------------------------------------------------


@dataclass(frozen=True)
class Latent:
    scores: DataFrame  # sample_id, vec (components)
    loadings: np.ndarray  # features x components
    variance: np.ndarray  # share per component
    mean: np.ndarray
    absent: np.ndarray | None = None  # what an absent cell of a sparse assay counts as, per feature


def pca(vecs: DataFrame, k: int | None = None, variance: float = 0.95) -> Latent:
    """Centred principal components; without k the fewest reaching ``variance``. Any number of dimensions."""
    mean, _ = vector_moments(vecs)
    rows = C.Rows(vecs.select("sample_id", F.col("vec").cast("array<double>").alias("vec")), len(mean), mean)
    share, loadings = C.principal(rows, k, variance)
    return Latent(C.project(rows, loadings), loadings, share, mean)


def joint_latent(assays: Mapping[str, DataFrame], k: int) -> tuple[Latent, DataFrame, list[str]]:
    """Joint representation of several modalities: PCA of the concatenated standardised features.

    An absent cell is a zero that is standardised like any other, one value per feature, and is never
    written; a null cell counts as the mean. Returns the latent, the given cells of the standardised long assay and the feature order.
    """
    from cohortia.operators.encode import standardise, standardised_zero
    from cohortia.operators.joins import concat_modalities
    from cohortia.sources.readers import feature_index

    raw = concat_modalities(assays)
    assay = standardise(raw)
    index = feature_index(assay)
    zeros = cut_lineage(standardised_zero(raw).join(index, "feature_id").withColumnRenamed("value", "zero"))
    found = zeros.orderBy("index").collect()  # one row per feature
    ids, absent = [r["feature_id"] for r in found], np.array([r["zero"] for r in found])
    cells = assay.join(zeros, "feature_id").select("sample_id", "index", (F.coalesce("value", F.lit(0.0)) - F.col("zero")).alias("val"))
    packed = F.array_sort(F.collect_list(F.struct("index", "val")))
    table = cells.groupBy("sample_id").agg(packed.alias("c")).select("sample_id", F.col("c.index").alias("idx"), F.col("c.val").alias("val"))
    rows = C.Rows(table, len(ids), np.zeros(len(ids)), absent)
    share, loadings = C.principal(rows, min(k, len(ids)), 1.0)
    return Latent(C.project(rows, loadings), loadings, share, np.zeros(len(ids)), absent), assay, ids


def reconstruct(latent: Latent, feature_ids: Sequence[str]) -> DataFrame:
    """Long (sample_id, feature_id, value) of scores x loadings' + mean."""
    L, mean = latent.loadings, latent.mean

    @F.pandas_udf(ArrayType(DoubleType()))
    def back(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ L.T + mean)) if len(v) else pd.Series([], dtype=object)

    names = F.array(*[F.lit(f) for f in feature_ids])
    return latent.scores.select("sample_id", F.posexplode(back("vec")).alias("i", "value")).select("sample_id", F.element_at(names, F.col("i") + 1).alias("feature_id"), "value")


def loadings_table(latent: Latent, feature_ids: Sequence[str], vecs: DataFrame) -> DataFrame:
    rows = [(c, f, float(latent.loadings[i, c])) for i, f in enumerate(feature_ids) for c in range(latent.loadings.shape[1])]
    return vecs.sparkSession.createDataFrame(rows, "component int, feature_id string, loading double")


def decoder_importance(loadings: DataFrame) -> DataFrame:
    """Sum of |loading| over components per feature."""
    return loadings.groupBy("feature_id").agg(F.sum(F.abs("loading")).alias("importance"))


#: Cells a task of ``latent_sensitivity`` has at least, and the tasks beyond which only the cells of each grow.
TASK_CELLS = 1 << 20
MOST_TASKS = 256


def _grid(samples: int, features: int, blocks: int, cores: int) -> tuple[int, int]:
    """Numbers of sample groups and of groups of feature blocks that copy few rows for about as many tasks as are wanted."""
    tasks = max(cores, min(samples * features // TASK_CELLS, max(MOST_TASKS, 2 * cores)))
    p = max(1, min(samples, round(math.sqrt(tasks * samples / features))))
    q = max(1, min(blocks, round(tasks / p)))
    return max(1, min(samples, round(tasks / q))), q


def latent_sensitivity(scores: DataFrame, loadings: DataFrame, block: int = 512) -> DataFrame:
    """Per (sample, feature): norm over components of score x loading.

    scores(sample_id, component, value) and loadings(component, feature_id, loading). Both sides
    become one array of squares per key in component order (a latent has few components);
    features travel in blocks, and the sum over components is unrolled into generated code.
    Samples and blocks are dealt into groups, and a pair of groups meets in one task. The number of tasks is
    bounded, so a row is copied a bounded number of times: what is shuffled grows as the input, not as the cells.
    """
    scores, loadings = written(scores), written(loadings)
    comps = sorted(r[0] for r in loadings.select("component").intersect(scores.select("component")).collect())
    square = lambda c, v: F.coalesce(F.sum(F.when(F.col("component") == c, F.col(v) * F.col(v))), F.lit(0.0))
    empty = F.array().cast("array<double>")
    s = scores.groupBy("sample_id").agg((F.array(*[square(c, "value") for c in comps]) if comps else F.first(empty)).alias("s"))
    f = loadings.groupBy("feature_id").agg((F.array(*[square(c, "loading") for c in comps]) if comps else F.first(empty)).alias("l"))
    n_features, n_samples = (max(1, df.agg(F.count_distinct(c)).first()[0]) for df, c in ((loadings, "feature_id"), (scores, "sample_id")))
    n_blocks = -(-n_features // block)
    p, q = _grid(n_samples, n_features, n_blocks, scores.sparkSession.sparkContext.defaultParallelism)
    blocks = f.withColumn("b", F.pmod(F.xxhash64("feature_id"), F.lit(n_blocks)).cast("int")).groupBy("b").agg(F.collect_list(F.struct("feature_id", "l")).alias("fs"))
    task = (F.col("i") * q + F.col("j")).alias("task")
    a = s.select("*", F.pmod(F.xxhash64("sample_id"), F.lit(p)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("j")).select(task, "sample_id", "s")
    b = blocks.select("fs", (F.col("b") % q).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("i")).select(task, "fs")
    # The copies are not in the planner's estimate of a side, so neither may be broadcast.
    pairs = a.repartitionById(p * q, F.col("task")).join(b.repartitionById(p * q, F.col("task")).hint("merge"), "task")
    cells = pairs.select("sample_id", "s", F.explode("fs").alias("x"))
    norm = F.sqrt(sum((F.col("s")[i] * F.col("x.l")[i] for i in range(len(comps))), F.lit(0.0)))
    return cells.select("sample_id", F.col("x.feature_id").alias("feature_id"), norm.alias("value"))
