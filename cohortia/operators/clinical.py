"""Clinical and omics table cleaning: projections, filters, barcodes, outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.ordered import first_row

# Raw column -> canonical name, per cohort family.
_COMMON = {
    "bcr_patient_barcode": "Barcode", "gender": "Gender", "race": "Race", "age_at_index": "Age",
    "vital_status": "OS", "days_to_death": "days_to_death", "days_to_last_follow_up": "days_to_last_follow_up",
    "primary_diagnosis": "primary_diagnosis", "tissue_or_organ_of_origin": "Tissue_Origin",
}
_AJCC = {"ajcc_pathologic_stage": "Stage", "ajcc_pathologic_t": "T", "ajcc_pathologic_n": "N", "ajcc_pathologic_m": "M"}
_SMOKING = {"pack_years_smoked": "pack_years_smoked", "cigarettes_per_day": "cigarettes_per_day"}
CLINICAL_COLUMNS: dict[str, dict[str, str]] = {
    "PAAD": {**_COMMON, **_SMOKING, **_AJCC},
    "HNSC": {**_COMMON, **_SMOKING, **_AJCC},
    "UCS": {**_COMMON, "height": "height", "weight": "weight", "bmi": "bmi", "ethnicity": "ethnicity",
            "cigarettes_per_day": "cigarettes_per_day", "figo_stage": "Stage"},
}


def select_clinical(raw: DataFrame, cohort: str) -> DataFrame:
    """Keep the cohort's clinical columns under canonical names; a missing column is an error."""
    mapping = CLINICAL_COLUMNS[cohort]
    missing = sorted(set(mapping) - set(raw.columns))
    if missing:
        raise ValueError(f"{cohort} clinical table lacks {missing}")
    return raw.select(*[F.col(k).alias(v) for k, v in mapping.items()])


def normalise_barcode(df: DataFrame, cols: Sequence[str], chars: str = "-.") -> DataFrame:
    return df.withColumns({c: F.translate(c, chars, "_" * len(chars)) for c in cols})


def patient_from_sample(df: DataFrame, col: str, length: int = 12, out: str = "patient_id") -> DataFrame:
    return df.withColumn(out, F.substring(col, 1, length))


def _sample_type(col: str) -> Column:
    return F.substring(col, 14, 2).try_cast("int")


def tissue_group(df: DataFrame, col: str, rule: str = "normal11", out: str = "Group") -> DataFrame:
    """``normal11``: type 11 is normal, the rest tumour. ``tumor01``: type 1 is tumour, the rest normal."""
    kind = _sample_type(col)
    if rule == "normal11":
        expr = F.when(kind == 11, "Normal").when(kind.isNotNull(), "Tumor")
    elif rule == "tumor01":
        expr = F.when(kind == 1, "Tumor").when(kind.isNotNull(), "Normal")
    else:
        raise ValueError(f"unknown rule {rule}")
    return df.withColumn(out, expr)


def split_cnv_segments(segments: DataFrame, col: str = "Sample") -> tuple[DataFrame, DataFrame]:
    tumour = F.coalesce(F.substring(col, 14, 2) == "01", F.lit(False))
    return segments.where(tumour), segments.where(~tumour)


def filter_cnv_markers(markers: DataFrame) -> DataFrame:
    return markers.where(~F.col("freqcnv")).select("probeid", "chr", "pos")


def filter_protein_coding(annotation: DataFrame, col: str = "transcript_biotype", keep: str = "protein_coding") -> DataFrame:
    return annotation.where(F.col(col) == keep)


def split_measure_families(wide: DataFrame, id_col: str, prefixes: Sequence[str]) -> dict[str, DataFrame]:
    """One long matrix per column-name prefix, the prefix stripped from the sample name."""
    out = {}
    for p in prefixes:
        cols = [c for c in wide.columns if c.startswith(p)]
        long = wide.select(id_col, *cols).unpivot([id_col], cols, "sample_id", "value")
        out[p] = long.withColumn("sample_id", F.substring("sample_id", len(p) + 1, 1 << 20))
    return out


def complete_features(assay: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Keep features with a non-null value in every sample."""
    present = F.count(F.when(F.col("value").isNotNull() & ~F.isnan("value"), 1))
    counts = assay.groupBy("feature_id").agg(present.alias("__n"))
    want = F.lit(n_samples) if n_samples is not None else assay.select("sample_id").distinct().agg(F.count(F.lit(1))).scalar()
    return assay.join(counts.where(F.col("__n") >= want).select("feature_id"), "feature_id", "left_semi").select(*assay.columns)


def drop_columns_like(df: DataFrame, pattern: str = "call") -> DataFrame:
    return df.select(*[c for c in df.columns if pattern not in c])


def exclude_meta_columns(features: DataFrame, names: Sequence[str]) -> DataFrame:
    return features.where(~F.col("feature_id").isin(list(names)))


def feature_groups_by_regex(features: DataFrame, pattern_levels: Sequence[Sequence[str]]) -> DataFrame:
    """(level, pattern, feature_id): each level's patterns search what the previous level's first pattern kept."""
    pool, parts = features.select("feature_id"), []
    for level, patterns in enumerate(pattern_levels):
        for p in patterns:
            parts.append(pool.where(F.col("feature_id").rlike(p)).select(F.lit(level).alias("level"), F.lit(p).alias("pattern"), "feature_id"))
        pool = pool.where(F.col("feature_id").rlike(patterns[0]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recode_categories(df: DataFrame, col: str, mapping: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    expr = F.col(col)
    for old, new in mapping.items():
        expr = F.when(F.col(col) == old, new).otherwise(expr)
    kept = df.where(F.col(col).isNull() | ~F.col(col).isin(list(drop))) if drop else df
    return kept.withColumn(col, expr)


def min_group_size(samples: DataFrame, by: str, n: int = 5) -> DataFrame:
    big = samples.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).select(by)
    return samples.join(big, by, "left_semi").select(*samples.columns)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first under an explicit order."""
    return first_row(df, keys, order)


def union_vital_status(clinical: DataFrame) -> DataFrame:
    """Dead rows keep days to death, alive rows days to last follow-up; other rows leave."""
    dead = F.col("OS") == "Dead"
    keep = [c for c in clinical.columns if c not in ("days_to_death", "days_to_last_follow_up")]
    return clinical.where(F.col("OS").isin("Dead", "Alive")).select(
        *keep, F.when(dead, F.col("days_to_death")).otherwise(F.col("days_to_last_follow_up")).alias("OS_Time"))


def os_flag_time(clinical: DataFrame, days_per_year: int = 365) -> DataFrame:
    return clinical.withColumns({
        "OS": F.when(F.col("OS") == "Dead", 1).otherwise(0),
        "OS_Time": F.col("OS_Time").cast("double") / days_per_year,
    })


def resolve_survival(df: DataFrame) -> DataFrame:
    """Add (event, time) from Status/Survival_in_days, else from vital status and day counts."""
    cols = set(df.columns)
    if {"Status", "Survival_in_days"} <= cols:
        return df.withColumns({"event": F.col("Status").cast("int"), "time": F.col("Survival_in_days").cast("double")})
    if {"vital_status", "days_to_death", "days_to_last_followup"} <= cols:
        dead = F.lower("vital_status") == "dead"
        return df.withColumns({
            "event": F.when(dead, 1).otherwise(0),
            "time": F.when(dead, F.col("days_to_death")).otherwise(F.col("days_to_last_followup")).cast("double"),
        })
    raise ValueError("no survival columns: need Status and Survival_in_days, or vital_status, days_to_death and days_to_last_followup")


def cast_outcomes(samples: DataFrame) -> DataFrame:
    """Status and Class become categories (strings), Survival_in_days a number; unreadable numbers become null."""
    new = {c: F.col(c).cast("string") for c in ("Status", "Class") if c in samples.columns}
    if "Survival_in_days" in samples.columns:
        new["Survival_in_days"] = F.col("Survival_in_days").try_cast("double")
    return samples.withColumns(new) if new else samples


def age_groups(df: DataFrame, col: str, cuts: Sequence[float], out: str = "age_group") -> DataFrame:
    """Label by cut points: ``<c1``, ``c1-c2``, ..., ``>=ck``."""
    expr = F.when(F.col(col).isNotNull(), f">={cuts[-1]}")
    labels = [(cuts[0], f"<{cuts[0]}")] + [(b, f"{a}-{b}") for a, b in zip(cuts, cuts[1:])]
    for bound, label in reversed(labels):
        expr = F.when(F.col(col) < bound, label).otherwise(expr)
    return df.withColumn(out, expr)


def type_defaults(df: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append feature rows, filling annotations they lack by type: '' / 0 / false."""
    missing = [f for f in df.schema.fields if f.name not in new_rows.columns]
    blank = {"string": "", "boolean": False}
    filled = new_rows.withColumns({f.name: F.lit(blank.get(f.dataType.simpleString(), 0)).cast(f.dataType) for f in missing}) if missing else new_rows
    return df.unionByName(filled.select(*df.columns))


def map_names(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Replace codes by readable names, unknown codes stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in (str(kv[0]), kv[1])])
    key = F.col(col).cast("string")
    return df.withColumn(out or col, F.coalesce(F.try_element_at(table, key), key))


def meta_map(df: DataFrame, cols: Sequence[str], out: str = "meta") -> DataFrame:
    """A metadata dictionary per row as JSON text, null entries left out."""
    return df.withColumn(out, F.to_json(F.struct(*[F.col(c) for c in cols])))


def meta_get(df: DataFrame, json_col: str, key: str, out: str) -> DataFrame:
    return df.withColumn(out, F.get_json_object(json_col, f"$.{key}"))
