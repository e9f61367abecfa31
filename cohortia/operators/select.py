"""Feature selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators import learn as L
from cohortia.operators.stats import anova_f, edger_two_group, limma_moderated_t


def select_k_best(assay: DataFrame, samples: DataFrame, k: int, target: str = "label") -> DataFrame:
    """k features with the largest ANOVA F against the target's classes; ties by id at 9 digits."""
    j = assay.select("sample_id", "feature_id", "value").join(samples.select("sample_id", target), "sample_id")
    return anova_f(j, target).select("feature_id", "f").where(F.col("f").isNotNull()).orderBy(F.round("f", 9).desc(), "feature_id").limit(k)


def select_from_model(weights: DataFrame, threshold: float | str = 1e-10, max_features: int | None = 400) -> DataFrame:
    """Features with |weight| at or above a threshold (or the mean |weight|), the largest ``max_features``."""
    a = weights.withColumn("__a", F.abs("weight"))
    cut = a.agg(F.avg("__a")).scalar() if threshold == "mean" else F.lit(float(threshold))
    kept = a.withColumn("__t", cut).where(F.col("__a") >= F.col("__t"))
    if max_features is not None:
        kept = kept.orderBy(F.desc("__a"), "feature_id").limit(max_features)
    return kept.drop("__a", "__t")


def select_limma(assay: DataFrame, samples: DataFrame, k: int, **options) -> DataFrame:
    t = limma_moderated_t(assay, samples, **options)
    return t.where(F.col("p").isNotNull()).orderBy("p", F.abs("t").desc(), "feature_id").limit(k).select("feature_id", "t", "p")


def select_edger(assay: DataFrame, samples: DataFrame, factors: DataFrame, k: int) -> DataFrame:
    t = edger_two_group(assay, samples, factors)
    return t.where(F.col("p").isNotNull()).orderBy("p", F.abs("z").desc(), "feature_id").limit(k).select("feature_id", "z", "p")


def _next_count(left: int, target: int, step: float, tune_step_at: int) -> int:
    """Features after one elimination round: a share (or number) until ``tune_step_at``, then one by one."""
    if left <= tune_step_at:
        drop = 1
    else:
        drop = max(1, int(step * left) if step < 1 else int(step))
        drop = min(drop, left - tune_step_at)
    return max(target, left - drop)


def rfe(
    vecs: DataFrame, feature_ids: Sequence[str], n: int, step: float = 0.05, tune_step_at: int = 1300,
    learner: L.Learner | None = None, protected: Sequence[str] = (),
) -> DataFrame:
    """Recursive elimination by smallest |weight| -> (feature_id, kept, round_dropped).

    Protected features (penalty factor 0) never leave. Each round is one distributed fit on the
    remaining dimensions; the log is feature-sized.
    """
    learner = learner or L.linear_svm()
    alive, dropped, rnd = list(range(len(feature_ids))), {}, 0
    guard = set(protected)
    floor = max(n, sum(f in guard for f in feature_ids))
    data = vecs.select("sample_id", "vec", "label").persist()
    zero, one = np.zeros(len(feature_ids)), np.ones(len(feature_ids))
    while len(alive) > floor:
        rnd += 1
        w = np.abs(L.fit(learner, L.scale_vectors(data, zero, one, alive)).weights())
        order = sorted((x for x in range(len(alive)) if feature_ids[alive[x]] not in guard), key=lambda x: (w[x], -alive[x]))
        out = {alive[x] for x in order[: len(alive) - _next_count(len(alive), floor, step, tune_step_at)]}
        if not out:
            break
        dropped |= {i: rnd for i in out}
        alive = [i for i in alive if i not in out]
    data.unpersist()
    rows = [(f, i not in dropped, dropped.get(i)) for i, f in enumerate(feature_ids)]
    return vecs.sparkSession.createDataFrame(rows, "feature_id string, kept boolean, round_dropped int")


def k_best_selector(k: int) -> L.Selector:
    """Selector for ``nested_cv``: ANOVA F on training vectors."""

    def choose(train: DataFrame, feature_ids: Sequence[str]) -> list[int]:
        long = train.select("sample_id", "label", F.posexplode("vec").alias("i", "value")).withColumn("feature_id", F.col("i"))
        top = anova_f(long, "label").where(F.col("f").isNotNull()).orderBy(F.desc("f"), "feature_id").limit(k).collect()
        return sorted(int(r["feature_id"]) for r in top)

    return choose


def model_selector(learner: L.Learner, threshold: float = 1e-10, max_features: int = 400) -> L.Selector:
    """Selector for ``nested_cv``: largest |weights| of a fitted model."""

    def choose(train: DataFrame, feature_ids: Sequence[str]) -> list[int]:
        w = np.abs(L.fit(learner, train).weights())
        order = sorted((i for i in range(len(w)) if w[i] >= threshold), key=lambda i: (-w[i], i))[:max_features]
        return sorted(order) or list(range(len(feature_ids)))

    return choose


def rfe_selector(n: int, step: float = 0.05, tune_step_at: int = 1300, learner: L.Learner | None = None, protected: Sequence[str] = ()) -> L.Selector:
    """Selector for ``nested_cv``: recursive elimination on training vectors."""

    def choose(train: DataFrame, feature_ids: Sequence[str]) -> list[int]:
        kept = {r["feature_id"] for r in rfe(train, feature_ids, n, step, tune_step_at, learner, protected).where("kept").collect()}
        return [i for i, f in enumerate(feature_ids) if f in kept]

    return choose
