"""Response, survival, comparison and representation studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators import clinical, cluster, encode, hazard, learn, metrics, results, splits, stats, vectors
from cohortia.operators.joins import merge_risk_scores, selection_stability
from cohortia.session import cut_lineage
from cohortia.sources.bundle import CohortBundle
from cohortia.sources.readers import feature_index, matrix_to_vectors


def encode_covariates(bundle: CohortBundle, columns: Sequence[str], ordinal: Mapping[str, Sequence[str]] | None = None) -> CohortBundle:
    """Add clinical covariates to the assay as never-penalised features (penalty factor 0).

    Numbers enter as they are, columns with a fixed order as their position, other text one-hot.
    A missing column, or a name the assay already has, is an error.
    """
    ordinal = ordinal or {}
    absent = [c for c in columns if c not in bundle.samples.columns]
    if absent:
        raise ValueError(f"sample table lacks {absent}")
    wide = bundle.samples.select("sample_id", *columns)
    text = {f.name for f in wide.schema.fields if f.dataType.simpleString() == "string"}
    for c in columns:
        if c in ordinal:
            wide = encode.ordinal_encode(wide, c, ordinal[c])
        elif c in text:
            wide = encode.one_hot(wide, c)
    names = [c for c in wide.columns if c != "sample_id"]
    if not bundle.features.where(F.col("feature_id").isin(names)).isEmpty():
        raise ValueError("a covariate has the name of an assay feature")
    cells = wide.select("sample_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["sample_id"], names, "feature_id", "value")
    cells = cells.where(F.col("value").isNotNull()).withColumn("modality", F.lit("clinical"))
    features = bundle.features if "penalty_factor" in bundle.features.columns else bundle.features.withColumn("penalty_factor", F.lit(1))
    new = bundle.assay.sparkSession.createDataFrame([(n, 0) for n in names], "feature_id string, penalty_factor int")
    return CohortBundle(bundle.assay.unionByName(cells.select(*bundle.assay.columns)), bundle.samples, clinical.type_defaults(features, new), bundle.meta)


def penalty_factors(bundle: CohortBundle, feature_ids: Sequence[str]) -> list[float] | None:
    """Penalty factors in feature order, or none when the bundle has no such column; feature-sized."""
    if "penalty_factor" not in bundle.features.columns:
        return None
    table = {r["feature_id"]: float(r["penalty_factor"]) for r in bundle.features.select("feature_id", "penalty_factor").collect()}
    return [table.get(f, 1.0) for f in feature_ids]


def bundle_vectors(bundle: CohortBundle, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Sample vectors joined with outcome columns, and the feature order (feature-sized list)."""
    index = feature_index(bundle.assay)
    ids = [r["feature_id"] for r in index.orderBy("index").collect()]
    return matrix_to_vectors(bundle.assay, index).join(bundle.samples.select("sample_id", *columns), "sample_id"), ids


def outer_splits(samples: DataFrame, k: int, repeats: int, grouped: bool, seed: int = 777) -> DataFrame:
    """(sample_id, split, part) from repeated stratified (group) k-fold: split = repeat x k + fold is the test part."""
    make = splits.repeated_stratified_group_kfold if grouped else splits.repeated_stratified_kfold
    folds = make(samples, k, repeats, seed).select("sample_id", "repeat", "fold")
    rows = folds.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select("sample_id", (F.col("repeat") * k + F.col("f")).alias("split"), F.when(F.col("fold") == F.col("f"), "test").otherwise("train").alias("part"))


def response_study(
    bundle: CohortBundle, model: str = "logreg", grid: Mapping[str, Sequence] | None = None, k: int = 4, repeats: int = 25, inner_k: int = 3,
    permutations: int = 1000, grouped: bool = False, selector: learn.Selector | None = None, seed: int = 777,
) -> dict[str, DataFrame]:
    """Nested cross-validation, then every table a response report needs, each one query over the logs.

    The permutation test refits the chosen linear models on permuted labels; with a selector, or a model that
    is not linear, it permutes the labels of the mean scores instead.
    """
    vecs, ids = bundle_vectors(bundle, ["label", *(["group_id"] if grouped else [])])
    vecs = cut_lineage(vecs)
    outer = outer_splits(bundle.samples.join(vecs.select("sample_id"), "sample_id", "left_semi"), k, repeats, grouped, seed)
    t = learn.nested_cv(vecs, ids, learn.LEARNERS[model], grid or {}, cut_lineage(outer), inner_k, selector=selector, model=model, seed=seed)
    te = t.split_scores.where("metric = 'roc_auc'")
    roc = metrics.roc_curve(t.predictions)
    at = F.coalesce(-F.col("threshold"), F.lit(float("-inf")))
    return {
        "predictions": t.predictions, "split_scores": t.split_scores, "cv_results": t.cv_results, "split_feature_weights": t.split_feature_weights,
        "score_summary": results.score_summary(t.split_scores),
        "param_profile": results.param_score_profile(t.cv_results),
        "feature_ranking": results.feature_ranking(t.split_feature_weights, te),
        "roc_band": metrics.mean_curve_band(metrics.interp_grid(roc, ["model", "split"], "fpr", "tpr", at)),
        "permutation": _response_permutation(vecs, t, model, k, repeats, permutations, selector is None, seed),
    }


def _response_permutation(vecs: DataFrame, t: learn.StudyTables, model: str, k: int, repeats: int, n: int, plain: bool, seed: int) -> DataFrame:
    """(true, mean_permuted, p) of a nested cross-validation."""
    refits = {s: learn.LEARNERS[model](**c) for s, c in t.chosen.items()}
    if plain and all(m.linear is not None and m.prepare is None for m in refits.values()):
        true = t.split_scores.where("metric = 'roc_auc' AND stage = 'te'").agg(F.avg("value")).first()[0]
        return learn.refit_permutation(vecs, refits, k, repeats, true, n, seed=seed)[0]
    mean = t.predictions.groupBy("sample_id").agg(F.avg("score").alias("score"), F.first("label").alias("label"))
    return stats.permutation_test(mean, "score", n, seed=seed, statistic="auc")


def survival_study(
    bundle: CohortBundle, l1_ratios: Sequence[float] = (0.5,), n_alphas: int = 100, n_splits: int = 100, test: float = 0.25, inner_k: int = 4,
    factors: Sequence[float] | None = None, max_iter: int = 100, by_group: bool = False, seed: int = 777, inner_repeats: int = 5,
) -> dict[str, DataFrame]:
    """Penalised Cox over hold-out splits: path on train, penalty by inner C-index over repeated folds, risk scores on test."""
    vecs, ids = bundle_vectors(bundle, ["time", "event", *(["group_id"] if by_group else [])])
    vecs = cut_lineage(vecs)
    factors = factors if factors is not None else penalty_factors(bundle, ids)
    spark = vecs.sparkSession
    cols = ["sample_id", "event", *(["group_id"] if by_group else [])]
    draw = splits.survival_sample_from_group if by_group else splits.survival_stratified_shuffle
    outer = cut_lineage(draw(vecs.select(*cols), n_splits, test, seed).select("sample_id", "split", "part"))
    weights, paths, preds = [], [], None
    for s in range(n_splits):
        part = vecs.join(outer.where(F.col("split") == s), "sample_id").select("sample_id", "vec", "time", "event", "part")
        train, held = part.where("part = 'train'"), part.where("part = 'test'")
        mean, std = learn.vector_moments(train)
        train = cut_lineage(learn.scale_vectors(train, mean, std))
        path = hazard.cox_elastic_net(train, factors, l1_ratios, n_alphas, max_iter=max_iter)
        paths.append(path)
        best = _best_penalty(train, path, factors, inner_k, inner_repeats, max_iter, seed)
        coef = path.coef[:, best]
        weights += [("cox", "all", s, f, float(w)) for f, w, pf in zip(ids, coef, factors or [1.0] * len(ids)) if w != 0 or pf == 0]
        scored = hazard.risk_scores(learn.scale_vectors(held, mean, std), coef).select(
            F.lit("cox").alias("model"), F.lit("all").alias("dataset"), F.lit(s).alias("split"), "sample_id", "time", "event", "score")
        scored = cut_lineage(scored)
        preds = scored if preds is None else preds.unionByName(scored)
    w = spark.createDataFrame(weights, "model string, dataset string, split int, feature_id string, weight double")
    c = metrics.c_index(preds, "score", ["model", "split"]).select("model", F.lit("all").alias("dataset"), "split", F.lit("te").alias("stage"), F.lit("c_index").alias("metric"), F.col("c_index").alias("value"))
    penalties = spark.createDataFrame([(r, i, a) for i, (r, a) in enumerate(hazard.average_path(paths))], "l1_ratio double, position int, alpha double")
    return {
        "risk_scores": preds, "merged_scores": merge_risk_scores(preds), "split_scores": c, "split_feature_weights": w,
        "score_summary": results.score_summary(c), "feature_ranking": results.feature_ranking(w, c), "mean_alpha_path": penalties,
    }


def _best_penalty(train: DataFrame, path: hazard.CoxPath, factors, inner_k: int, inner_repeats: int, max_iter: int, seed: int) -> int:
    """Index of the penalty with the best mean C-index over repeated inner event-stratified folds; all penalties per fold in one solve.

    A fold without comparable pairs has no C-index and counts in no mean.
    """
    folds = cut_lineage(splits.repeated_survival_stratified_kfold(train, inner_k, inner_repeats, seed))
    total, seen = np.zeros(len(path.grid)), np.zeros(len(path.grid))
    f = None if factors is None else np.asarray(factors, dtype=float)
    for r in range(inner_repeats):
        for k in range(inner_k):
            of_repeat = folds.where(F.col("repeat") == r)
            problem = hazard.CoxProblem(of_repeat.where(F.col("fold") != k))
            try:
                fit = hazard.solve(problem, path.grid, f, max_iter)
            finally:
                problem.close()
            scores = of_repeat.where(F.col("fold") == k).select("sample_id", "time", "event", F.posexplode(hazard._linear(fit.coef)("vec")).alias("penalty", "score"))
            for row in metrics.c_index(cut_lineage(scores), "score", ["penalty"]).collect():
                if row["c_index"] is not None:
                    total[row["penalty"]] += row["c_index"]
                    seen[row["penalty"]] += 1
    mean = np.where(seen > 0, total / np.maximum(seen, 1), -np.inf)
    return int(np.argmax(np.round(mean, 12)))


def model_comparison(scores: DataFrame, weights: DataFrame | None = None, metric: str = "roc_auc", top: int = 15) -> dict[str, DataFrame]:
    """Ranks, paired tests, performance table, winners and shared features of several models."""
    ranks = results.rank_models(scores, metric)
    out = {
        "ranks": ranks, "mean_rank": results.mean_rank(ranks), "rank_distribution": results.rank_distribution(ranks),
        "paired_t": results.paired_t(scores, metric), "performance": results.model_performance_table(scores), "best": results.best_model_per_dataset(scores, metric),
    }
    if weights is not None:
        out["top_features"] = results.model_top_features(weights, top)
    return out


def comparison_summary(scores: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """One row per model: mean rank, wins, mean and std of the metric."""
    c = model_comparison(scores, None, metric)
    wins = c["best"].groupBy("model").agg(F.count(F.lit(1)).alias("wins"))
    perf = c["performance"].where(F.col("metric") == metric).select("model", "mean", "std", "n")
    return c["mean_rank"].join(perf, "model").join(wins, "model", "left").select("model", "mean_rank", F.coalesce("wins", F.lit(0)).alias("wins"), "mean", "std", "n")


def representation_report(assays: Mapping[str, DataFrame], labels: DataFrame, k: int, clusters: int, selected: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(metric, value): reconstruction error and correlation, silhouette and ARI of the latent, stability of selections."""
    latent, assay, ids = learn.joint_latent(assays, k)
    spark = assay.sparkSession
    assay, scores = cut_lineage(assay), cut_lineage(latent.scores)
    recon = cut_lineage(learn.reconstruct(learn.Latent(scores, latent.loadings, latent.variance, latent.mean), ids))
    # Every cell is judged, absent ones by what they count as; the reconstruction holds them all anyway.
    absent = spark.createDataFrame([(f, float(v)) for f, v in zip(ids, latent.absent)], "feature_id string, zero double").join(assay.select("feature_id", "modality").distinct(), "feature_id")
    given = assay.select("sample_id", "feature_id", F.struct(F.coalesce("value", F.lit(0.0)).alias("value")).alias("cell"))
    assay = recon.select("sample_id", "feature_id").join(absent, "feature_id").join(given, ["sample_id", "feature_id"], "left")
    assay = cut_lineage(assay.select("sample_id", "feature_id", "modality", F.coalesce("cell.value", "zero").alias("value")))
    m = stats.mse(assay, recon).select(F.concat(F.lit("mse_"), "modality").alias("metric"), F.col("mse").alias("value"))
    r = stats.pearson_by_feature(assay, recon).agg(F.avg("r").alias("value")).select(F.lit("mean_pearson").alias("metric"), "value")
    lab = scores.join(labels.select("sample_id", "label"), "sample_id")
    sil = vectors.silhouette(lab).agg(F.avg("silhouette").alias("value")).select(F.lit("silhouette").alias("metric"), "value")
    got, _, _ = cluster.kmeans(scores, clusters, seed)
    ari = stats.adjusted_rand(got.select(F.col("id").alias("sample_id"), F.col("cluster").alias("label")), labels).select(F.lit("adjusted_rand").alias("metric"), F.col("ari").alias("value"))
    share = spark.createDataFrame([("explained_variance", float(latent.variance.sum()))], "metric string, value double")
    out = m.unionByName(r).unionByName(sil).unionByName(ari).unionByName(share)
    if selected is not None:
        out = out.unionByName(selection_stability(selected).select(F.lit("selection_stability").alias("metric"), F.col("stability").alias("value")))
    return out
