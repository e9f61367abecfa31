"""Alignment, annotation and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.absent import moments, n_distinct, quantiles_with_zeros
from cohortia.operators.ordered import first_row, weighted_quantiles
from cohortia.session import cut_lineage, written


def annotate_genes(assay: DataFrame, annotation: DataFrame, biotype: str | None = "protein_coding") -> DataFrame:
    """Attach gene symbols to an assay, keeping the feature id for the duplicate rule that follows."""
    ann = annotation if biotype is None else annotation.where(F.col("biotype") == biotype)
    return assay.join(ann.select("feature_id", "symbol").distinct(), "feature_id").select(
        "sample_id", "feature_id", "symbol", "value")


def feature_median(assay: DataFrame) -> DataFrame:
    """Exact median per feature over all samples; absent cells are zeros."""
    return quantiles_with_zeros(assay, {"median": 0.5})


def collapse_duplicate_genes(annotated: DataFrame) -> DataFrame:
    """Per symbol keep the feature with the highest median; the smaller id wins a tie.

    Absent cells are zeros. Medians are taken only where a symbol has several features, from counts
    per value that are written once; the assay is written too, and read for them, for its samples and
    for the result.
    """
    annotated = written(annotated)
    counted = cut_lineage(annotated.groupBy("symbol", "feature_id", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    names = counted.groupBy("symbol").agg(F.collect_set("feature_id").alias("ids"))  # a symbol has few features
    several = names.where(F.size("ids") > 1).select("symbol", F.explode("ids").alias("feature_id"))
    per = counted.join(several, ["symbol", "feature_id"], "left_semi").groupBy("feature_id", "value").agg(F.sum("n").alias("n"))
    zeros = per.groupBy("feature_id").agg(F.sum("n").alias("c")).select("feature_id", F.lit(0.0).alias("value"), (n_distinct(annotated) - F.col("c")).alias("n"))
    counts = cut_lineage(per.where(F.col("value").isNotNull()).unionByName(zeros).groupBy("feature_id", "value").agg(F.sum("n").alias("n")))
    med = weighted_quantiles(counts, ["feature_id"], "value", "n", {"median": 0.5})
    best = several.join(med, "feature_id", "left").groupBy("symbol").agg(
        F.min_by("feature_id", F.struct(-F.coalesce("median", F.lit(float("-inf"))), F.col("feature_id"))).alias("best"))
    kept = annotated.join(best, "symbol", "left").where(F.col("best").isNull() | (F.col("best") == F.col("feature_id")))
    return kept.select("sample_id", F.col("symbol").alias("feature_id"), "value")


def common_ids(*dfs: DataFrame, key: str = "sample_id") -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [d.select(key) for d in dfs])


def align_samples(*tables: DataFrame, key: str = "sample_id") -> list[DataFrame]:
    """Every table restricted to the keys present in all of them; the common keys are written once."""
    common = cut_lineage(reduce(lambda a, b: a.join(b, key, "left_semi"), [t.select(key).distinct() for t in tables]))
    return [t.join(common, key, "left_semi").select(*t.columns) for t in tables]


def attach_patient_outcome(samples: DataFrame, clinical: DataFrame, sample_col: str = "sample_id", patient_col: str = "patient_id", length: int = 12) -> DataFrame:
    keyed = samples.withColumn("__p", F.substring(sample_col, 1, length))
    return keyed.join(clinical, F.col("__p") == clinical[patient_col]).drop("__p")


def attach_protocol(samples: DataFrame, protocol: DataFrame, prefix: str = "protocol_", key: str = "sample_id") -> DataFrame:
    renamed = protocol.select(key, *[F.col(c).alias(prefix + c) for c in protocol.columns if c != key])
    return samples.join(renamed, key, "left")


def join_labels(values: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    return values.join(labels, key)


def concat_modalities(assays: Mapping[str, DataFrame], sep: str = ":") -> DataFrame:
    """One long assay over all modalities, feature names prefixed by the modality."""
    parts = [
        a.select("sample_id", F.concat_ws(sep, F.lit(m), F.col("feature_id")).alias("feature_id"), "value", F.lit(m).alias("modality"))
        for m, a in assays.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def late_integration(preds: DataFrame, model_weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean score per (split, sample) over the models that scored it; a null score has no weight."""
    w = F.lit(1.0)
    for m, v in (model_weights or {}).items():
        w = F.when(F.col("model") == m, F.lit(float(v))).otherwise(w)
    scored = preds.withColumn("__w", F.when(F.col("score").isNotNull(), w))
    total = F.sum("__w")
    return scored.groupBy("split", "sample_id").agg(
        F.when(total != 0, F.sum(F.col("score") * F.col("__w")) / total).alias("score"),
        F.count("score").alias("n_models"))


def _outer_by_split(df: DataFrame, key: str, value: str, by: Sequence[str]) -> DataFrame:
    """Every (key, split) cell of a full outer merge, absent cells null.

    The splits of one model are a short list, so they travel as an array on each key
    instead of a product of two tables.
    """
    splits = df.select(*by, "split").distinct().groupBy(*by).agg(F.collect_set("split").alias("__splits"))
    keys = df.select(*by, key).distinct()
    grid = (keys.join(splits, list(by)) if by else keys.withColumn("__splits", splits.agg(F.first("__splits")).scalar()))
    grid = grid.select(*by, key, F.explode("__splits").alias("split"))
    return grid.join(df.select(*by, key, "split", value), [*by, key, "split"], "left")


def merge_split_weights(weights: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return _outer_by_split(weights, "feature_id", "weight", list(by))


def merge_risk_scores(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return _outer_by_split(preds, "sample_id", "score", list(by))


def attach_weights(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Feature rows with their model weight; a feature weighted twice fails the job."""
    per = weights.groupBy("feature_id").agg(F.count(F.lit(1)).alias("__n"), F.max("weight").alias("weight"))
    checked = per.withColumn("weight", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate weight for "), "feature_id")).cast("double")).otherwise(F.col("weight")))
    return features.join(checked.drop("__n"), "feature_id")


def drop_unpenalised_zero(weights: DataFrame, features: DataFrame) -> DataFrame:
    """Keep a feature when its weight is not zero or its penalty factor is zero."""
    pf = features.select("feature_id", "penalty_factor")
    return weights.join(pf, "feature_id").where((F.col("weight") != 0) | (F.col("penalty_factor") == 0))


def attach_annotations(results: DataFrame, features: DataFrame, cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join annotations, the first duplicate wins, absent text becomes ''."""
    one = first_row(features.select("feature_id", *cols), ["feature_id"], order)
    text = [f.name for f in one.schema.fields if f.dataType.simpleString() == "string" and f.name != "feature_id"]
    return results.join(one, "feature_id", "left").fillna("", subset=text)


def pathway_members_in_assay(members: DataFrame, features: DataFrame) -> DataFrame:
    return members.join(features.select("feature_id").distinct(), "feature_id", "left_semi").select(*members.columns)


def hierarchy_join(members: DataFrame, process_members: DataFrame) -> DataFrame:
    return members.join(process_members, "pathway_id").select("feature_id", "pathway_id", "process_id")


def pathway_size_filter(members: DataFrame, lo: int = 5, hi: int = 200) -> DataFrame:
    sizes = members.groupBy("pathway_id").agg(F.count_distinct("feature_id").alias("__n"))
    return members.join(sizes.where(F.col("__n").between(lo, hi)).select("pathway_id"), "pathway_id", "left_semi").select(*members.columns)


def variance_filter(assay: DataFrame, min_var: float = 0.3) -> DataFrame:
    """Features whose variance over all samples, absent cells as zeros, reaches ``min_var``."""
    keep = moments(assay).where((F.col("n") > 1) & (F.col("m2") / (F.col("n") - 1) >= min_var))
    return assay.join(keep.select("feature_id"), "feature_id", "left_semi").select(*assay.columns)


def paired_by_dataset(scores: DataFrame, metric: str) -> DataFrame:
    """Scores of two models on every dataset where each has exactly one value, model_a < model_b.

    The models of one dataset travel as one short array, so a pair never costs a join.
    """
    one = scores.where(F.col("metric") == metric).groupBy("dataset", "model").agg(
        F.count("value").alias("__n"), F.max("value").alias("value")).where("__n = 1")
    arr = one.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("model", "value"))).alias("__a"))
    left = arr.select("dataset", "__a", F.posexplode("__a").alias("__i", "a"))
    return left.select("dataset", "a", F.explode(F.slice("__a", F.col("__i") + 2, F.size("__a"))).alias("b")).select(
        "dataset", F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"),
        F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


def pairwise_sets(sets: DataFrame, run_col: str = "run", item_col: str = "item") -> DataFrame:
    """Every pair of runs with both set sizes, the intersection and the Jaccard index.

    The run names come to the driver (one per run). An item sends one row per run it is in,
    and the partners are counted as one column per run, so no pair of rows is formed.
    """
    uniq = sets.select(F.col(run_col).alias("run"), F.col(item_col).alias("item")).distinct()
    runs = [r["run"] for r in uniq.select("run").distinct().orderBy("run").collect()]
    names = [f"r{i}" for i in range(len(runs))]
    held = uniq.groupBy("item").agg(F.collect_set("run").alias("rs"))
    table = held.select("rs", F.explode("rs").alias("run_a")).groupBy("run_a").agg(
        F.count(F.lit(1)).alias("n_a"), *[F.count_if(F.array_contains("rs", F.lit(r))).alias(c) for r, c in zip(runs, names)])
    sizes = table.select(F.col("run_a").alias("run_b"), F.col("n_a").alias("n_b"))
    cells = F.array(*[F.struct(F.lit(r).alias("run_b"), F.col(c).alias("common")) for r, c in zip(runs, names)])
    grid = table.select("run_a", "n_a", F.inline(cells)).where("run_a < run_b").join(sizes, "run_b")
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return grid.select("run_a", "run_b", "n_a", "n_b", "common", F.when(union == 0, 0.0).otherwise(F.col("common") / union).alias("jaccard"))


def jaccard(a: DataFrame, b: DataFrame, item_col: str = "item") -> DataFrame:
    """One row with the Jaccard index of two sets, 0 when both are empty."""
    sides = a.select(item_col, F.lit(1).alias("s")).union(b.select(item_col, F.lit(2).alias("s"))).distinct()
    per = sides.groupBy(item_col).agg(F.sum("s").alias("m"))
    both, any_ = F.count(F.when(F.col("m") == 3, 1)), F.count(F.lit(1))
    return per.agg(F.when(any_ == 0, 0.0).otherwise(both / any_).alias("jaccard"))


def overlap_counts(sets: DataFrame, by: str = "run", item_col: str = "item") -> DataFrame:
    return pairwise_sets(sets, by, item_col).select("run_a", "run_b", "n_a", "n_b", "common")


def selection_stability(sets: DataFrame, run_col: str = "run", item_col: str = "item") -> DataFrame:
    return pairwise_sets(sets, run_col, item_col).agg(F.avg("jaccard").alias("stability"), F.count(F.lit(1)).alias("n_pairs"))


def union_cohorts(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def model_by_dataset(models: Sequence[str], datasets: DataFrame) -> DataFrame:
    """One job row per (dataset, model); the model list is configuration, so it is an array literal."""
    return datasets.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def top_features(df: DataFrame, by: str, n: int = 20, tie: str = "feature_id") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def top_per_group(df: DataFrame, group: str | Sequence[str], by: str, n: int, tie: str) -> DataFrame:
    """First n rows per group; Spark prunes each map task to n rows per group before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sort_report(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    return df.orderBy(*keys)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing) for every column of a narrow table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "missing")


def cohort_summary(samples: DataFrame, assay: DataFrame) -> DataFrame:
    """Samples, features, and the share of samples with an event."""
    n_features = assay.agg(F.count_distinct("feature_id")).scalar()
    return samples.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("event").cast("bigint").alias("n_events"), F.avg("event").alias("event_rate")).withColumn(
        "n_features", n_features)


def group_sample_weights(samples: DataFrame) -> DataFrame:
    """Weight of a sample = largest group size / size of its own group."""
    sizes = samples.groupBy("group_id").agg(F.count(F.lit(1)).alias("__n"))
    biggest = sizes.agg(F.max("__n")).scalar()
    return samples.join(sizes.withColumn("sample_weight", biggest.cast("double") / F.col("__n")).drop("__n"), "group_id").select(*samples.columns, "sample_weight")


def pivot_wide_values(values: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One column per requested id; for a handful of ids only."""
    return values.groupBy("sample_id").agg(*[F.sum(F.when(F.col("feature_id") == i, F.col("value"))).alias(i) for i in ids])
