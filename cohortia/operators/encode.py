"""Encoding, imputation and scaling of covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.absent import moments
from cohortia.operators.ordered import quantiles

# Fixed value lists.
TUMOR_STAGES = ("0", "i", "i or ii", "ii", "NA", "iii", "iv")
CANCER_STAGES = {"I": 0, "II": 1, "III": 2, "IV": 3, "V": 4}
POSITIVE = ("positive", "yes", "responsive")
NEGATIVE = ("negative", "no", "non-responsive")


def ordinal_encode(df: DataFrame, col: str, order: Sequence[str] = TUMOR_STAGES, out: str | None = None) -> DataFrame:
    """Position of the category in a fixed order. An unknown category fails the job.

    Like the encoder it stands for, a constant column is left out: the result then has no
    encoded column and the caller drops the covariate.
    """
    few = df.select(col).where(F.col(col).isNotNull()).distinct().limit(2).count()
    if few < 2:
        return df.drop(col)
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col))
    code = F.when(pos == 0, F.raise_error(F.concat(F.lit(f"unknown {col}: "), F.col(col))).cast("int")).otherwise((pos - 1).cast("int"))
    return df.withColumn(out or col, F.when(F.col(col).isNotNull(), code))


def stage_to_int(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in CANCER_STAGES.items() for x in kv])
    return df.withColumn(out or col, F.try_element_at(table, F.col(col)))


def response_to_int(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    low = F.lower(F.trim(col))
    return df.withColumn(out or col, F.when(low.isin(*POSITIVE), 1).when(low.isin(*NEGATIVE), 0))


def _categories(df: DataFrame, col: str, skip: Sequence[str] = ()) -> list[str]:
    """Distinct values of one categorical covariate, sorted; a covariate has few."""
    rows = df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().collect()
    return sorted(r["v"] for r in rows if r["v"] not in skip)


def _flag(col: str, value: str) -> Column:
    return F.coalesce(F.col(col).cast("string") == value, F.lit(False)).cast("int").alias(f"{col}_{value}".replace(" ", "_"))


def one_hot(df: DataFrame, col: str, na: str = "NA") -> DataFrame:
    """More than two real categories: one flag each; exactly two: the second only; one: nothing."""
    cats = _categories(df, col, (na,))
    wanted = cats if len(cats) > 2 else cats[1:]
    return df.select(*[c for c in df.columns if c != col], *[_flag(col, v) for v in wanted])


def dummy_encode(df: DataFrame, cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """Flags per category, originals dropped; a constant column yields nothing when the first is dropped."""
    flags = []
    for c in cols:
        cats = _categories(df, c)
        flags += [_flag(c, v) for v in (cats[1:] if drop_first else cats)]
    return df.select(*[c for c in df.columns if c not in cols], *flags)


def impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Nulls become the exact median (numeric) or the most frequent value, smallest on a tie."""
    new = {}
    for c in numeric:
        median = quantiles(df, [], c, {"q": 0.5}).select("q").scalar()
        new[c] = F.coalesce(F.col(c).cast("double"), median)
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        new[c] = F.coalesce(F.col(c), counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar())
    return df.withColumns(new)


def _scale(assay: DataFrame, ddof: int) -> DataFrame:
    """feature_id, __m and __s: mean and std over all samples, absent cells as zeros; zero std counts as 1."""
    std = F.sqrt(F.col("m2") / F.when(F.col("n") > ddof, F.col("n") - ddof))
    return moments(assay).select("feature_id", F.col("mean").alias("__m"), F.when(std > 1e-12 * F.abs("mean"), std).otherwise(1.0).alias("__s"))


def standardise(assay: DataFrame, fit_on: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    """(value - mean) / std per feature, moments from ``fit_on`` (training rows).

    Absent cells are zeros and enter the moments; only the given cells are written. What an
    absent cell would become, one number per feature, is told by ``standardised_zero``.
    """
    stats = _scale(fit_on if fit_on is not None else assay, ddof)
    return assay.join(stats, "feature_id").withColumn("value", (F.col("value") - F.col("__m")) / F.col("__s")).select(*assay.columns)


def standardised_zero(assay: DataFrame, fit_on: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    """feature_id and the standardised value of its absent cells."""
    return _scale(fit_on if fit_on is not None else assay, ddof).select("feature_id", (-F.col("__m") / F.col("__s")).alias("value"))


def label_encode(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Sorted categories numbered from 0."""
    cats = _categories(df, col)
    pos = F.array_position(F.array(*[F.lit(c) for c in cats]), F.col(col).cast("string"))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), (pos - 1).cast("int")))
