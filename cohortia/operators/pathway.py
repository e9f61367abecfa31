"""Pathway membership, scores and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions import tails
from cohortia.operators.ordered import quantiles
from cohortia.operators.stats import welch_t


def membership_matrix(features: DataFrame, members: DataFrame) -> DataFrame:
    """(feature_id, pathway_id) rows: the ones of the binary matrix, measured features only."""
    return members.join(features.select("feature_id").distinct(), "feature_id", "left_semi").select("feature_id", "pathway_id").distinct()


def pathway_coverage(features: DataFrame, members: DataFrame) -> DataFrame:
    """One row: features, features in no pathway, mean and exact median of pathways per feature."""
    n = features.select("feature_id").distinct().join(members.select("feature_id", "pathway_id").distinct(), "feature_id", "left").groupBy("feature_id").agg(F.count("pathway_id").alias("n"))
    med = quantiles(n, [], "n", {"m": 0.5}).select("m").scalar()
    return n.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("n") == 0).alias("n_uncovered"), F.avg("n").alias("mean_pathways")).withColumn("median_pathways", med)


def pathway_score(assay: DataFrame, members: DataFrame, weights: DataFrame | None = None, relu: bool = False, absent: DataFrame | None = None) -> DataFrame:
    """Mean (or weighted mean) member value per (sample, pathway), long as feature_id = pathway_id.

    A null value has no weight. ``absent`` gives what an absent cell of a feature stands for
    (feature_id, value), such as ``standardised_zero``: then every sample has a score for every
    pathway with a member in the assay. Without it only measured cells count.
    """
    m = members.select("feature_id", "pathway_id").distinct()
    if weights is not None:
        m = m.join(weights.select("feature_id", "pathway_id", F.col("weight").alias("w")), ["feature_id", "pathway_id"])
    else:
        m = m.withColumn("w", F.lit(1.0))
    j = assay.select("sample_id", "feature_id", "value").join(m, "feature_id")
    size = F.when(F.col("value").isNotNull(), F.abs("w"))
    if absent is None:
        sums = j.groupBy("sample_id", "pathway_id").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(size).alias("n"))
    else:
        base = absent.select("feature_id", F.col("value").alias("base"))
        # Every cell starts at its absent value; given cells move the sums, null ones leave them.
        whole = m.join(base, "feature_id").groupBy("pathway_id").agg(F.sum(F.col("w") * F.col("base")).alias("s0"), F.sum(F.abs("w")).alias("n0"))
        moved = j.join(base, "feature_id").groupBy("sample_id", "pathway_id").agg(
            F.sum(F.col("w") * (F.coalesce("value", F.lit(0.0)) - F.col("base"))).alias("s1"), F.sum(F.when(F.col("value").isNull(), F.abs("w")).otherwise(0.0)).alias("n1"))
        listed = whole.agg(F.collect_list(F.struct("pathway_id", "s0", "n0"))).scalar()  # one entry per pathway
        grid = assay.select("sample_id").distinct().select("sample_id", F.inline(listed))
        sums = grid.join(moved, ["sample_id", "pathway_id"], "left").select(
            "sample_id", "pathway_id", (F.col("s0") + F.coalesce("s1", F.lit(0.0))).alias("s"), (F.col("n0") - F.coalesce("n1", F.lit(0.0))).alias("n"))
    out = sums.select("sample_id", "pathway_id", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("value"))
    v = F.greatest(F.col("value"), F.lit(0.0)) if relu else F.col("value")
    return out.select("sample_id", F.col("pathway_id").alias("feature_id"), v.alias("value"))


def process_score(scores: DataFrame, process_members: DataFrame) -> DataFrame:
    """Next level: mean pathway score per (sample, process)."""
    j = scores.join(process_members.select(F.col("pathway_id").alias("feature_id"), "process_id").distinct(), "feature_id")
    return j.groupBy("sample_id", F.col("process_id").alias("feature_id")).agg(F.avg("value").alias("value"))


def pathway_importance(scores: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Mean activation per pathway with its rank (one row per pathway) and name."""
    agg = scores.groupBy("feature_id").agg(F.avg("value").alias("importance"))
    out = agg.withColumn("rank", F.row_number().over(Window.orderBy(F.round("importance", 9).desc(), "feature_id")))
    return out if names is None else out.join(names, "feature_id", "left").withColumn("name", F.coalesce("name", "feature_id"))


def differential_pathways(scores: DataFrame, samples: DataFrame, group: str = "label") -> DataFrame:
    return welch_t(scores, samples, group)


def gene_importance(pathway_weights: DataFrame, how: str = "sum") -> DataFrame:
    """Sum (or mean) of |weight| over pathways per gene."""
    f = F.sum if how == "sum" else F.avg
    return pathway_weights.groupBy("feature_id").agg(f(F.abs("weight")).alias("importance"))


def pathway_enrichment(selected: DataFrame, members: DataFrame, universe: DataFrame) -> DataFrame:
    """Over-representation of a selected set per pathway: overlap, sizes, hypergeometric upper tail."""
    u = universe.select("feature_id").distinct()
    s = selected.select("feature_id").distinct().join(u, "feature_id", "left_semi").withColumn("__hit", F.lit(1))
    m = members.select("feature_id", "pathway_id").distinct().join(u, "feature_id", "left_semi").join(s, "feature_id", "left")
    per = m.groupBy("pathway_id").agg(F.count(F.lit(1)).alias("size"), F.count("__hit").alias("overlap"))
    full = per.withColumns({"selected": s.agg(F.count(F.lit(1))).scalar(), "universe": u.agg(F.count(F.lit(1))).scalar()})
    return full.withColumn("p", tails.hypergeom_upper("overlap", "selected", "size", "universe"))


def class_pathways(scores: DataFrame, samples: DataFrame, members: DataFrame, process_members: DataFrame, cls: int, n: int = 5) -> DataFrame:
    """Top pathways of one class with up to n member genes (first by id) and all parent processes."""
    top = scores.join(samples.where(F.col("label") == cls).select("sample_id"), "sample_id", "left_semi").groupBy(F.col("feature_id").alias("pathway_id")).agg(F.avg("value").alias("activation"))
    top = top.orderBy(F.round("activation", 9).desc(), "pathway_id").limit(n)
    w = Window.partitionBy("pathway_id").orderBy("feature_id")
    genes = members.join(top.select("pathway_id"), "pathway_id", "left_semi").select("pathway_id", "feature_id").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    genes = genes.groupBy("pathway_id").agg(F.array_join(F.array_sort(F.collect_list("feature_id")), ",").alias("genes"))
    procs = process_members.select("pathway_id", "process_id").distinct().groupBy("pathway_id").agg(F.array_join(F.array_sort(F.collect_list("process_id")), ",").alias("processes"))
    return top.join(genes, "pathway_id", "left").join(procs, "pathway_id", "left").select("pathway_id", "activation", "genes", F.coalesce("processes", F.lit("")).alias("processes"))
