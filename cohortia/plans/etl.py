"""Clinical and expression ETL as one lazy plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators import clinical as C
from cohortia.operators import joins as J
from cohortia.session import cut_lineage
from cohortia.sources.bundle import CohortBundle


def clinical_etl(raw: DataFrame, cohort: str, order: Sequence[Column]) -> DataFrame:
    """Raw clinical rows -> one row per patient with an outcome flag and years."""
    one = C.distinct_first(raw, ["bcr_patient_barcode"], order)
    named = C.normalise_barcode(C.select_clinical(one, cohort), ["Barcode"])
    return C.os_flag_time(C.union_vital_status(named))


def expression_etl(profile: DataFrame, annotation: DataFrame, clinical: DataFrame, biotype: str | None = "protein_coding") -> CohortBundle:
    """Expression profile -> symbol-level assay aligned with the clinical table."""
    genes = cut_lineage(J.collapse_duplicate_genes(J.annotate_genes(profile, annotation, biotype)))
    assay, samples = J.align_samples(genes.withColumn("modality", F.lit("rna")), clinical)
    features = annotation.select(F.col("symbol").alias("feature_id")).distinct()
    kept = J.pathway_members_in_assay(features, assay)
    return CohortBundle(assay, samples, kept, {"level": "symbol"})
