"""Absent cells of a long count table are zeros: the operators here use them without writing them.

An assay holds only some of its (sample, feature) cells. Moments, medians and totals add the zeros
by number. A null value is a cell that was looked at and not measured: it is left out, not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.ordered import weighted_quantiles
from cohortia.session import cut_lineage, forget, written


def n_distinct(assay: DataFrame, col: str = "sample_id") -> Column:
    """Number of samples (or features) of an assay, as a scalar."""
    return assay.agg(F.count_distinct(col)).scalar()


def value_counts(assay: DataFrame, by: str = "feature_id", of: str = "sample_id") -> DataFrame:
    """(by, value, n): how often each value occurs, the zeros of absent cells among them; written, since quantiles read it again."""
    given, assay = assay, written(assay)
    cells = assay.where(F.col("value").isNotNull()).groupBy(by, F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    zeros = assay.groupBy(by).agg(F.count(F.lit(1)).alias("c")).select(by, F.lit(0.0).alias("value"), (n_distinct(assay, of) - F.col("c")).alias("n"))
    counts = cut_lineage(cells.unionByName(zeros).groupBy(by, "value").agg(F.sum("n").alias("n")).where("n > 0"))
    if assay is not given:
        forget(assay)
    return counts


def quantiles_with_zeros(assay: DataFrame, probs: dict[str, float], by: str = "feature_id", of: str = "sample_id") -> DataFrame:
    """Exact interpolated quantiles per ``by`` over all of its cells, absent ones as zeros."""
    return weighted_quantiles(value_counts(assay, by, of), [by], "value", "n", probs)


def moments(assay: DataFrame) -> DataFrame:
    """Per feature: n, mean and m2 (sum of squared deviations) over all samples, absent cells as zeros."""
    per = assay.groupBy("feature_id").agg(
        F.count("value").alias("c"), F.count_if(F.col("value").isNull()).alias("gone"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("a"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    per = per.withColumn("n", n_distinct(assay) - F.col("gone"))
    c, a, n = F.col("c"), F.col("a"), F.col("n")
    return per.select("feature_id", n, F.when(n > 0, a * c / n).alias("mean"), F.when(n > 0, F.col("v") * c + a * a * c * (n - c) / n).alias("m2"))


def complete_grid(assay: DataFrame, fill: float = 0.0) -> DataFrame:
    """Every (sample, feature) cell of an assay, absent ones as ``fill``; as large as a full matrix.

    Only for results in which an absent cell is no longer a constant. The feature names travel as
    one array, which a matrix of that width holds in every row anyway.
    """
    assay = written(assay)  # read for its features, its samples and its cells
    names = assay.agg(F.collect_set("feature_id")).scalar()
    grid = assay.select("sample_id").distinct().withColumn("feature_id", F.explode(names))
    cells = assay.select("sample_id", "feature_id", F.struct("value").alias("cell"))
    return grid.join(cells, ["sample_id", "feature_id"], "left").select("sample_id", "feature_id", F.when(F.col("cell").isNull(), F.lit(fill)).otherwise(F.col("cell.value")).alias("value"))
