"""Count normalisation and feature filters on the long assay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.absent import complete_grid, moments, n_distinct, quantiles_with_zeros, value_counts
from cohortia.operators.ordered import quantiles, weighted_quantiles
from cohortia.session import cut_lineage, written


def _per_sample(assay: DataFrame, agg: Column) -> DataFrame:
    return assay.groupBy("sample_id").agg(agg)


def _share(value: Column, total: str) -> Column:
    """Part of a sample's total; every part of an all-zero sample is zero."""
    return F.when(F.col(total) != 0, value / F.col(total)).when(value.isNotNull(), 0.0)


def normalize_total_log1p(assay: DataFrame, target: float = 1e4) -> DataFrame:
    """Scale every sample to ``target`` total, then ln(1 + x). A sample of zeros stays zero."""
    tot = _per_sample(assay, F.sum("value").alias("__t"))
    return assay.join(tot, "sample_id").withColumn("value", F.log1p(_share(F.col("value"), "__t") * target)).select(*assay.columns)


def relative_abundance(assay: DataFrame) -> DataFrame:
    tot = _per_sample(assay, F.sum("value").alias("__t"))
    return assay.join(tot, "sample_id").withColumn("value", _share(F.col("value"), "__t")).select(*assay.columns)


def clr(assay: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """Centred log ratio over all features, absent cells as zeros; only the given cells are written."""
    logged = assay.withColumn("value", F.log(F.col("value") + pseudocount))
    sums = logged.groupBy("sample_id").agg(F.sum("value").alias("__t"), F.count(F.lit(1)).alias("__c"), F.count("value").alias("__k"))
    absent = n_distinct(assay, "feature_id") - F.col("__c")
    mean = sums.select("sample_id", ((F.col("__t") + absent * math.log(pseudocount)) / (absent + F.col("__k"))).alias("__m"))
    return logged.join(mean, "sample_id").withColumn("value", F.col("value") - F.col("__m")).select(*assay.columns)


def prevalence_filter(assay: DataFrame, min_value: float, min_share: float) -> DataFrame:
    """Keep features reaching ``min_value`` in at least ``min_share`` of all samples."""
    n = assay.agg(F.count_distinct("sample_id")).scalar()
    hits = assay.groupBy("feature_id").agg(F.count_if(F.col("value") >= min_value).alias("__n"))
    keep = hits.where(F.col("__n") >= n * F.lit(min_share)).select("feature_id")
    return assay.join(keep, "feature_id", "left_semi").select(*assay.columns)


def tpm(assay: DataFrame, lengths: DataFrame) -> DataFrame:
    """Value per feature length, rescaled to one million per sample."""
    rate = assay.join(lengths.select("feature_id", "length"), "feature_id").withColumn("__r", F.col("value") / F.col("length"))
    tot = _per_sample(rate, F.sum("__r").alias("__t"))
    return rate.join(tot, "sample_id").withColumn("value", _share(F.col("__r"), "__t") * 1e6).select(*assay.columns)


def aggregate_features(assay: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sum features to their group (taxon, pathway): mapping(feature_id, group_id)."""
    return assay.join(mapping, "feature_id").groupBy("sample_id", "group_id").agg(F.sum("value").alias("value")).withColumnRenamed("group_id", "feature_id")


def feature_distribution(assay: DataFrame) -> DataFrame:
    """Univariate summary per feature over all samples with exact quartiles; absent cells are zeros."""
    assay = written(assay)
    counts = value_counts(assay)
    ends = counts.groupBy("feature_id").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    std = F.sqrt(F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1)).alias("std")
    summary = moments(assay).select("feature_id", "n", "mean", std).join(ends, "feature_id")
    return summary.join(weighted_quantiles(counts, ["feature_id"], "value", "n", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "feature_id")


def filter_by_expr(assay: DataFrame, groups: DataFrame | None = None, min_count: float = 10, min_total: float = 15) -> DataFrame:
    """Keep genes whose CPM reaches the cutoff in enough samples and whose total count suffices (Chen, Lun & Smyth 2016).

    The cutoff is ``min_count`` in a library of median size; enough is the smallest class size,
    and above ten 10 + 0.7 (size - 10). Absent cells count as zero.
    """
    lib = _per_sample(assay, F.sum("value").alias("__lib"))
    median_lib = quantiles(lib, [], "__lib", {"q": 0.5}).select("q").scalar()
    if groups is None:
        size = lib.agg(F.count(F.lit(1))).scalar()
    else:
        sizes = groups.join(lib, "sample_id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        size = sizes.agg(F.min("n")).scalar()
    cpm = assay.join(lib, "sample_id").withColumn("__cpm", F.col("value") / F.col("__lib") * 1e6)
    marked = cpm.withColumns({"__cut": F.lit(float(min_count)) / median_lib * 1e6, "__size": size.cast("double")})
    per = marked.groupBy("feature_id").agg(
        F.count_if(F.col("__cpm") >= F.col("__cut")).alias("n"), F.sum("value").alias("total"), F.max("__size").alias("size"))
    enough = F.when(F.col("size") > 10, 10 + 0.7 * (F.col("size") - 10)).otherwise(F.col("size"))
    keep = per.where((F.col("n") >= enough - 1e-14) & (F.col("total") >= min_total - 1e-14)).select("feature_id")
    return assay.join(keep, "feature_id", "left_semi").select(*assay.columns)


def tmm_factors(assay: DataFrame, m_trim: float = 0.3, a_trim: float = 0.05) -> DataFrame:
    """(sample_id, lib, factor): trimmed mean of M values (Robinson & Oshlack 2010).

    The reference sample has its upper quartile, over all features that any sample has, closest to the
    mean one. Ranks for the trims run inside one sample, whose cells are bounded by the number of
    features.
    """
    assay = written(assay)
    pos = assay.where("value > 0").select("sample_id", "feature_id", "value")
    lib = assay.groupBy("sample_id").agg(F.sum("value").alias("lib"))
    scaled = pos.join(lib, "sample_id").withColumn("__s", F.col("value") / F.col("lib"))
    shares = scaled.select("sample_id", "feature_id", F.col("__s").alias("value"))
    uq = cut_lineage(quantiles_with_zeros(shares, {"uq": 0.75}, "sample_id", "feature_id").join(lib, "sample_id"))  # one row per sample
    gap = F.round(F.abs(F.col("uq") - uq.agg(F.avg("uq")).scalar()), 12)
    ref_id = uq.withColumn("__d", gap).agg(F.min_by("sample_id", F.struct("__d", "sample_id"))).first()[0]
    ref = scaled.where(F.col("sample_id") == F.lit(ref_id)).select("feature_id", F.col("value").alias("r"), F.col("lib").alias("nr"))
    cells = scaled.join(ref, "feature_id").withColumns({
        "m": F.log2(F.col("value") / F.col("lib")) - F.log2(F.col("r") / F.col("nr")),
        "a": (F.log2(F.col("value") / F.col("lib")) + F.log2(F.col("r") / F.col("nr"))) / 2,
        "v": (F.col("lib") - F.col("value")) / F.col("lib") / F.col("value") + (F.col("nr") - F.col("r")) / F.col("nr") / F.col("r"),
    })
    by_sample = Window.partitionBy("sample_id")
    tie = lambda c: (F.count(F.lit(1)).over(Window.partitionBy("sample_id", c)) - 1) / 2.0
    ranked = cells.withColumns({"rm": F.rank().over(by_sample.orderBy("m")) + tie("m"), "ra": F.rank().over(by_sample.orderBy("a")) + tie("a"), "n": F.count(F.lit(1)).over(by_sample)})
    lo_m, lo_a = F.floor(F.col("n") * m_trim) + 1, F.floor(F.col("n") * a_trim) + 1
    kept = ranked.where((F.col("rm") >= lo_m) & (F.col("rm") <= F.col("n") + 1 - lo_m) & (F.col("ra") >= lo_a) & (F.col("ra") <= F.col("n") + 1 - lo_a))
    raw = kept.groupBy("sample_id").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("lf"))
    raw = cut_lineage(lib.join(raw, "sample_id", "left").withColumn("lf", F.coalesce("lf", F.lit(0.0))))
    centre = raw.agg(F.avg("lf")).scalar()
    return raw.select("sample_id", "lib", F.pow(F.lit(2.0), F.col("lf") - centre).alias("factor"))


def log_cpm(assay: DataFrame, factors: DataFrame, prior: float = 1.0) -> DataFrame:
    """log2 counts per million with a prior scaled to each library; lib = total x factor.

    An absent cell is a zero count and gets the prior of its sample, so the result holds every cell.
    """
    eff = factors.select("sample_id", (F.col("lib") * F.col("factor")).alias("__l"))
    mean = eff.agg(F.avg("__l")).scalar()
    p = F.lit(prior) * F.col("__l") / F.col("__mean")
    out = complete_grid(assay).join(eff.withColumn("__mean", mean), "sample_id")
    return out.select("sample_id", "feature_id", F.log2((F.col("value") + p) / (F.col("__l") + 2 * p) * 1e6).alias("value"))
