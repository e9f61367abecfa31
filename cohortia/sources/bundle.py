"""The three-table bundle: assay, samples, features, plus a metadata map."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CohortBundle:
    """Long assay (sample_id, feature_id, value, modality) with its two metadata tables."""

    assay: DataFrame
    samples: DataFrame
    features: DataFrame
    meta: dict[str, str] = field(default_factory=dict)


def bundle_write(bundle: CohortBundle, path: str, mode: str = "errorifexists") -> None:
    """Parquet tables under ``path``; the assay is partitioned by modality for pruning."""
    bundle.assay.write.mode(mode).partitionBy("modality").parquet(f"{path}/assay")
    bundle.samples.write.mode(mode).parquet(f"{path}/samples")
    bundle.features.write.mode(mode).parquet(f"{path}/features")
    spark = bundle.assay.sparkSession
    rows = [(str(k), str(v)) for k, v in bundle.meta.items()]
    spark.createDataFrame(rows, "key string, value string").write.mode(mode).parquet(f"{path}/meta")


def bundle_read(spark: SparkSession, path: str) -> CohortBundle:
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}
    return CohortBundle(
        spark.read.parquet(f"{path}/assay").select("sample_id", "feature_id", "value", "modality"),
        spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/features"), meta)


def default_names(assay: DataFrame, sample_index: str | None = None, feature_index: str | None = None) -> DataFrame:
    """Name unnamed samples ``Sample_i`` and features ``Feature_i`` from their position columns."""
    out = assay
    if sample_index:
        out = out.withColumn("sample_id", F.concat(F.lit("Sample_"), F.col(sample_index).cast("string"))).drop(sample_index)
    if feature_index:
        out = out.withColumn("feature_id", F.concat(F.lit("Feature_"), F.col(feature_index).cast("string"))).drop(feature_index)
    return out
