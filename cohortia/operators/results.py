"""Aggregation of model results over splits: rankings, profiles, comparisons, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.tails import t_pvalue
from cohortia.operators.joins import paired_by_dataset, pivot_wide_values
from cohortia.operators.ordered import quantiles, running_totals


def score_summary(scores: DataFrame, by: Sequence[str] = ("model", "dataset", "stage", "metric")) -> DataFrame:
    """Mean and population std over splits; failed splits carry null and are ignored."""
    ok = scores.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n_splits"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def cv_report(scores: DataFrame) -> DataFrame:
    return score_summary(scores, ("model", "metric"))


def param_score_profile(cv_results: DataFrame) -> DataFrame:
    """Per parameter value: mean and std over splits of the best mean score any combination reached."""
    long = cv_results.select("split", "metric", "mean_score", "std_score", F.explode("params").alias("param", "value"))
    multi = long.groupBy("param").agg(F.count_distinct("value").alias("__n")).where("__n > 1").select("param")
    best = long.join(multi, "param", "left_semi").where(F.col("mean_score").isNotNull()).groupBy("split", "param", "value", "metric").agg(
        F.max(F.struct("mean_score", -F.col("std_score"))).alias("b"))
    return best.groupBy("param", "value", "metric").agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg("b.mean_score").alias("mean_score"), F.stddev_pop("b.mean_score").alias("std_score"),
        F.avg(-F.col("b.col2")).alias("mean_std"))


def selection_frequency(weights: DataFrame, n_splits: int | None = None) -> DataFrame:
    """Number and percentage of a model's splits that selected each feature."""
    freq = weights.groupBy("model", "feature_id").agg(F.count_distinct("split").alias("n"))
    if n_splits is not None:
        return freq.withColumn("percent", F.col("n") * 100.0 / n_splits)
    total = weights.groupBy("model").agg(F.count_distinct("split").alias("__s"))
    return freq.join(total, "model").select("model", "feature_id", "n", (F.col("n") * 100.0 / F.col("__s")).alias("percent"))


def mean_importance(weights: DataFrame) -> DataFrame:
    out = weights.groupBy("model", "feature_id").agg(F.avg("weight").alias("importance"), F.count(F.lit(1)).alias("n"))
    return out.orderBy("model", F.desc(F.abs("importance")), "feature_id")


def rank_features(weights: DataFrame) -> DataFrame:
    """Rank |weight| descending within (model, split), ties share the smallest rank; plus the split's feature count."""
    w = weights.withColumn("__a", F.abs("weight"))
    counts = w.groupBy("model", "split", "__a").agg(F.count(F.lit(1)).alias("__c"))
    cum = running_totals(counts, ["model", "split"], "__a", {"__cum": "__c"}, ascending=False)
    ranks = cum.select("model", "split", "__a", (F.col("__cum") - F.col("__c") + 1).alias("rank"))
    sizes = counts.groupBy("model", "split").agg(F.sum("__c").alias("n_present"))
    return w.join(ranks, ["model", "split", "__a"]).join(sizes, ["model", "split"]).select("model", "split", "feature_id", "weight", "rank", "n_present")


def feature_ranking(weights: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Frequency, mean rank, mean weight and mean test score per feature over all splits of a model.

    A feature absent from a split ranks behind that split's features, weighs 0 and scores 0.5.
    The sums over absent splits are differences from per-model totals, so no grid of
    features by splits is built. A test score that does not vary over features is null.
    """
    ranked = rank_features(weights)
    per_split = ranked.groupBy("model", "split").agg((F.max("n_present") + 1).alias("last"))
    totals = per_split.groupBy("model").agg(F.count(F.lit(1)).alias("s"), F.sum("last").alias("all_last"))
    if scores is not None:
        ranked = ranked.join(scores.select("model", "split", F.col("value").alias("__score")), ["model", "split"], "left")
    else:
        ranked = ranked.withColumn("__score", F.lit(None).cast("double"))
    agg = ranked.groupBy("model", "feature_id").agg(
        F.count(F.lit(1)).alias("frequency"), F.sum(F.col("rank") - F.col("n_present") - 1).alias("__r"),
        F.sum("weight").alias("__w"), F.sum("__score").alias("__sc"), F.count("__score").alias("__ns"))
    out = agg.join(totals, "model").select(
        "model", "feature_id", "frequency", ((F.col("__r") + F.col("all_last")) / F.col("s")).alias("mean_rank"),
        (F.col("__w") / F.col("s")).alias("mean_weight"),
        F.when(F.col("__ns") > 0, (F.col("__sc") + 0.5 * (F.col("s") - F.col("__ns"))) / F.col("s")).alias("mean_test_score"))
    spread = out.groupBy("model").agg((F.max("mean_test_score") > F.min("mean_test_score")).alias("__varies"))
    return out.join(spread, "model").withColumn("mean_test_score", F.when(F.col("__varies"), F.col("mean_test_score"))).drop("__varies")


def rank_models(scores: DataFrame, metric: str) -> DataFrame:
    """Rank of each model per dataset, best first, ties averaged. A dataset holds one row per model."""
    one = scores.where(F.col("metric") == metric)
    w, tie = Window.partitionBy("dataset").orderBy(F.desc("value")), Window.partitionBy("dataset", "value")
    return one.select("model", "dataset", "value", (F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0).alias("rank"))


def mean_rank(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_datasets"))


def rank_distribution(ranks: DataFrame, top: int = 4) -> DataFrame:
    """(model, place, n): how often each model took each of the first places."""
    wide = ranks.groupBy("model").agg(*[F.count_if(F.col("rank") == k).alias(str(k)) for k in range(1, top + 1)])
    return wide.unpivot(["model"], [str(k) for k in range(1, top + 1)], "place", "n").withColumn("place", F.col("place").cast("int"))


def best_model_per_dataset(scores: DataFrame, metric: str = "roc_auc") -> DataFrame:
    one = scores.where(F.col("metric") == metric)
    return one.groupBy("dataset").agg(F.min_by(F.struct("model", "value"), F.struct(-F.col("value"), F.col("model"))).alias("b")).select("dataset", "b.*")


def model_performance_table(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def paired_t(scores: DataFrame, metric: str) -> DataFrame:
    """Paired t test of every model pair over their common datasets (at least two)."""
    diff = paired_by_dataset(scores, metric).withColumn("__d", F.col("value_a") - F.col("value_b"))
    agg = diff.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean_diff"), F.stddev_samp("__d").alias("sd")).where("n >= 2")
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    return agg.select("model_a", "model_b", "n", "mean_diff", t.alias("t")).withColumn("p", t_pvalue("t", (F.col("n") - 1).cast("double")))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """(label, pred, n) over the full square of classes, zeros included."""
    counts = preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.agg(F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("pred")))).scalar()
    grid = counts.select("label").union(counts.select("pred")).distinct().withColumn("pred", F.explode(classes))
    return grid.join(counts, ["label", "pred"], "left").fillna(0, subset=["n"])


def classification_report(preds: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support; then accuracy, macro and weighted averages."""
    cm = preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = cm.select(F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("sup").alias("support"), F.sum("prd").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    pr = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0))
    cols = ["precision", "recall", "f1"]
    rows = per.select(F.col("c").cast("string").alias("class"), *cols, "support")
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    acc = F.sum("tp") / F.sum("support")
    return (
        rows.unionByName(per.agg(*[acc.alias(c) for c in cols], F.sum("support").alias("support")).withColumn("class", F.lit("accuracy")))
        .unionByName(per.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg")))
        .unionByName(per.agg(*[w(c) for c in cols], F.sum("support").alias("support")).withColumn("class", F.lit("weighted avg")))
    )


def normalise_within_sample(importance: DataFrame, eps: float = 1e-10) -> DataFrame:
    tot = importance.groupBy("sample_id").agg(F.sum("value").alias("__t"))
    return importance.join(tot, "sample_id").withColumn("value", F.col("value") / (F.col("__t") + eps)).select(*importance.columns)


def sample_top_quartile(importance: DataFrame, q: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """Flag features at or above the sample's own quantile."""
    cut = quantiles(importance, ["sample_id"], "value", {"__q": q})
    return importance.join(cut, "sample_id").withColumn("top", F.col("value") >= F.col("__q")).drop("__q")


def frequency_select(importance: DataFrame, global_importance: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of samples where a feature is in the sample's top quartile; importance = global x share."""
    n = importance.agg(F.count_distinct("sample_id")).scalar()
    flagged = sample_top_quartile(normalise_within_sample(importance))
    share = flagged.groupBy("feature_id").agg(F.count_if("top").alias("__k")).withColumn("share", F.col("__k") / n)
    return share.join(global_importance, "feature_id").select(
        "feature_id", "share", (F.col("share") >= threshold).alias("selected"), (F.col("importance") * F.col("share")).alias("importance"))


def stratified_frequency_select(
    importance: DataFrame, samples: DataFrame, stratum: str, threshold: float = 0.7, min_n: int = 5, global_importance: DataFrame | None = None,
) -> DataFrame:
    """The same share inside each stratum of at least ``min_n`` samples, with importance = global x share if given."""
    s = samples.select("sample_id", F.col(stratum).alias("stratum")).where(F.col("stratum").isNotNull()).join(importance.select("sample_id").distinct(), "sample_id", "left_semi")
    sizes = s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    flagged = sample_top_quartile(normalise_within_sample(importance))
    per = flagged.join(s, "sample_id").groupBy("stratum", "feature_id").agg(F.count_if("top").alias("k"))
    out = per.join(sizes, "stratum").withColumn("share", F.col("k") / F.col("n")).select("stratum", "feature_id", "n", "share", (F.col("share") >= threshold).alias("selected"))
    if global_importance is None:
        return out
    return out.join(global_importance, "feature_id").withColumn("importance", F.col("importance") * F.col("share"))


def cumulative_variance(components: DataFrame, target: float = 0.90) -> DataFrame:
    """Running share of explained variance over k component rows and whether k components suffice."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    tot = components.agg(F.sum("variance")).scalar()
    out = components.withColumn("__tot", tot).select("component", "variance", (F.sum("variance").over(w) / F.col("__tot")).alias("cumulative"))
    return out.withColumn("reached", F.col("cumulative") >= target)


def sorted_heatmap(values: DataFrame, samples: DataFrame, top_ids: Sequence[str], group: str = "label") -> DataFrame:
    """Top features as columns, samples as rows, sorted by group and then by the values."""
    wide = pivot_wide_values(values.where(F.col("feature_id").isin(list(top_ids))), top_ids)
    return samples.select("sample_id", group).join(wide, "sample_id").orderBy(group, *[F.col(f"`{i}`") for i in top_ids], "sample_id")


def histogram(df: DataFrame, col: str, bins: int | str = "fd") -> DataFrame:
    """Equal-width histogram with empty bins; ``fd`` picks range / (2 IQR / n^(1/3)) bins."""
    ok = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = ok.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))).scalar()
    if bins == "fd":
        q = quantiles(ok, [], "v", {"a": 0.25, "b": 0.75}).select((F.col("b") - F.col("a")).alias("iqr")).scalar()
        base = ok.withColumns({"s": stats, "iqr": q})
        k = F.greatest(F.lit(1), F.round((F.col("s.hi") - F.col("s.lo")) / (2 * F.col("iqr") / F.pow(F.col("s.n").cast("double"), F.lit(1.0 / 3)))).cast("int"))
    else:
        base, k = ok.withColumn("s", stats), F.lit(int(bins))
    base = base.withColumn("k", k).withColumn("w", (F.col("s.hi") - F.col("s.lo")) / F.col("k"))
    raw = F.when(F.col("w") > 0, F.floor((F.col("v") - F.col("s.lo")) / F.col("w"))).otherwise(0)
    counts = base.withColumn("bin", F.least(raw, F.col("k") - 1).cast("int")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.max("s.lo").alias("lo"), F.max("w").alias("w"))
    shape = counts.agg(F.max("k").alias("k"), F.max("lo").alias("lo"), F.max("w").alias("w")).select(
        F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "lo", "w")
    return shape.join(counts.select("bin", "n"), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("left"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def model_top_features(weights: DataFrame, n: int = 15) -> DataFrame:
    """Features with the largest mean selection percentage over models, with each model's percentage."""
    freq = selection_frequency(weights)
    top = freq.groupBy("feature_id").agg(F.avg("percent").alias("mean_percent")).orderBy(F.desc("mean_percent"), "feature_id").limit(n)
    return freq.join(top, "feature_id")
