"""Projections, filters, joins, sets and simple aggregates."""

from pyspark.sql import functions as F

from cohortia.catalog.registry import register
from cohortia.operators import clinical as C
from cohortia.operators import joins as J
from cohortia.sources import adapters as A


def _raw(spark, d):
    """Clinical rows with every column the three cohort families ask for."""
    r = A.clinical(spark, d)
    return r.withColumns({
        "pack_years_smoked": F.col("age_at_index") * 2, "cigarettes_per_day": F.col("bmi") / 10, "ajcc_pathologic_stage": F.col("tumor_stage"),
        "ajcc_pathologic_t": F.substring("primary_diagnosis", 2, 1), "ajcc_pathologic_n": F.col("race"), "ajcc_pathologic_m": F.col("gender"),
        "height": F.col("bmi") + 1, "weight": F.col("bmi") + 2, "ethnicity": F.col("race"), "figo_stage": F.col("tumor_stage"),
    })


RAW = f"""SELECT *, age_at_index * 2 AS pack_years_smoked, bmi / 10 AS cigarettes_per_day, tumor_stage AS ajcc_pathologic_stage,
 substr(primary_diagnosis, 2, 1) AS ajcc_pathologic_t, race AS ajcc_pathologic_n, gender AS ajcc_pathologic_m,
 bmi + 1 AS height, bmi + 2 AS weight, race AS ethnicity, tumor_stage AS figo_stage FROM ({A.CLINICAL})"""
_BASE = """bcr_patient_barcode AS "Barcode", gender AS "Gender", race AS "Race", age_at_index AS "Age", vital_status AS "OS", days_to_death,
 days_to_last_follow_up, primary_diagnosis, tissue_or_organ_of_origin AS "Tissue_Origin" """
_AJCC = ', pack_years_smoked, cigarettes_per_day, ajcc_pathologic_stage AS "Stage", ajcc_pathologic_t AS "T", ajcc_pathologic_n AS "N", ajcc_pathologic_m AS "M"'
_UCS = ', height, weight, bmi, ethnicity, cigarettes_per_day, figo_stage AS "Stage"'

for _cohort, _extra in (("PAAD", _AJCC), ("HNSC", _AJCC), ("UCS", _UCS)):
    register(f"select_clinical_{_cohort.lower()}", f"SELECT {_BASE}{_extra} FROM ({RAW})")(
        lambda spark, d, cohort=_cohort: C.select_clinical(_raw(spark, d), cohort))


@register("normalise_barcode", f"SELECT visit, translate(sample_barcode, '-.', '__') AS sample_barcode FROM ({A.CLINICAL})")
def _(spark, d):
    return C.normalise_barcode(A.clinical(spark, d), ["sample_barcode"]).select("visit", "sample_barcode")


@register("patient_from_sample", f"SELECT visit, substr(sample_barcode, 1, 12) AS patient_id FROM ({A.CLINICAL})")
def _(spark, d):
    return C.patient_from_sample(A.clinical(spark, d), "sample_barcode").select("visit", "patient_id")


@register("tissue_group", f"""SELECT visit, CASE WHEN CAST(substr(sample_barcode, 14, 2) AS INTEGER) = 11 THEN 'Normal' ELSE 'Tumor' END AS "Group",
 CASE WHEN CAST(substr(sample_barcode, 14, 2) AS INTEGER) = 1 THEN 'Tumor' ELSE 'Normal' END AS by_tumour_code FROM ({A.CLINICAL})""")
def _(spark, d):
    df = C.tissue_group(A.clinical(spark, d), "sample_barcode")
    return C.tissue_group(df, "sample_barcode", "tumor01", "by_tumour_code").select("visit", "Group", "by_tumour_code")


@register("split_cnv_segments", f"""SELECT visit, CASE WHEN substr(sample_barcode, 14, 2) = '01' THEN 'tumour' ELSE 'other' END AS part FROM ({A.CLINICAL})""")
def _(spark, d):
    tumour, other = C.split_cnv_segments(A.clinical(spark, d), "sample_barcode")
    return tumour.select("visit", F.lit("tumour").alias("part")).union(other.select("visit", F.lit("other")))


@register("filter_cnv_markers", "SELECT 'F' || p_partkey AS probeid, p_brand AS chr, p_size AS pos FROM part WHERE p_type <> 'PROMO'")
def _(spark, d):
    p = A.table(spark, d, "part")
    return C.filter_cnv_markers(p.select(F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("probeid"), F.col("p_brand").alias("chr"),
                                         F.col("p_size").alias("pos"), (F.col("p_type") == "PROMO").alias("freqcnv")))


@register("filter_protein_coding", f"SELECT * FROM ({A.FEATURES}) WHERE biotype = 'STANDARD'")
def _(spark, d):
    return C.filter_protein_coding(A.features(spark, d), "biotype", "STANDARD")


_WIDE = """SELECT l_orderkey AS mirna_id, {aggs} FROM lineitem GROUP BY 1"""
_COLS = [("read_count_", "l_quantity"), ("reads_per_million_miRNA_mapped_", "l_extendedprice")]


@register("split_measure_families", "SELECT l_orderkey AS mirna_id, 'L' || k AS sample_id, max(CASE WHEN l_linenumber = k THEN v END) AS value, family FROM ("
          "SELECT l_orderkey, l_linenumber, l_quantity AS v, 'read_count_' AS family FROM lineitem UNION ALL "
          "SELECT l_orderkey, l_linenumber, l_extendedprice, 'reads_per_million_miRNA_mapped_' FROM lineitem) AS s, "
          "(SELECT DISTINCT l_linenumber AS k FROM lineitem) AS ks GROUP BY 1, 2, 4")
def _(spark, d):
    li = A.table(spark, d, "lineitem")
    lines = sorted(r[0] for r in li.select("l_linenumber").distinct().collect())  # an order has few lines
    wide = li.groupBy(F.col("l_orderkey").alias("mirna_id")).agg(*[
        F.max(F.when(F.col("l_linenumber") == k, F.col(c))).alias(f"{p}L{k}") for p, c in _COLS for k in lines])
    parts = C.split_measure_families(wide, "mirna_id", [p for p, _ in _COLS])
    return J.union_cohorts(*[df.withColumn("family", F.lit(p)) for p, df in parts.items()])


@register("complete_features", f"""SELECT * FROM ({A.BRAND_ASSAY}) WHERE feature_id || modality IN (SELECT feature_id || modality FROM ({A.BRAND_ASSAY})
 GROUP BY feature_id || modality HAVING count(*) = (SELECT count(DISTINCT l_suppkey) FROM lineitem))""")
def _(spark, d):
    a = A.brand_assay(spark, d)
    keyed = a.withColumn("feature_id", F.concat("feature_id", F.lit("|"), "modality"))
    return C.complete_features(keyed).withColumn("feature_id", F.split_part("feature_id", F.lit("|"), F.lit(1)))


@register("drop_columns_like", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    return C.drop_columns_like(A.table(spark, d, "orders"), "date").drop("o_orderpriority")


@register("exclude_meta_columns", f"SELECT feature_id FROM ({A.FEATURES}) WHERE feature_id NOT IN ('F0', 'F1', 'F2')")
def _(spark, d):
    return C.exclude_meta_columns(A.features(spark, d), ["F0", "F1", "F2"]).select("feature_id")


@register("feature_groups_by_regex", f"""WITH f AS (SELECT feature_id FROM ({A.FEATURES})), k AS (SELECT * FROM f WHERE regexp_matches(feature_id, '^F1.+$'))
 SELECT 0 AS level, '^F1.+$' AS pattern, feature_id FROM k UNION ALL SELECT 0, '^F[2-9]', feature_id FROM f WHERE regexp_matches(feature_id, '^F[2-9]')
 UNION ALL SELECT 1, '5$', feature_id FROM k WHERE regexp_matches(feature_id, '5$')
 UNION ALL SELECT 1, '[^5]$', feature_id FROM k WHERE regexp_matches(feature_id, '[^5]$')""")
def _(spark, d):
    return C.feature_groups_by_regex(A.features(spark, d), [["^F1.+$", "^F[2-9]"], ["5$", "[^5]$"]])


@register("recode_categories", "SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, d):
    return C.recode_categories(A.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"FURNITURE": "HOUSEHOLD"}, ["BUILDING"])


@register("variance_filter", f"SELECT * FROM ({A.ASSAY}) WHERE feature_id IN (SELECT feature_id FROM ({A.grid_sql(A.ASSAY)}) GROUP BY 1 HAVING var_samp(value) >= 250)")
def _(spark, d):
    return J.variance_filter(A.assay(spark, d), 250)


@register("pathway_size_filter", f"SELECT * FROM ({A.MEMBERS}) WHERE pathway_id IN (SELECT pathway_id FROM ({A.MEMBERS}) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 80)")
def _(spark, d):
    return J.pathway_size_filter(A.members(spark, d), 5, 80)


@register("drop_unpenalised_zero", f"""SELECT w.*, penalty_factor FROM (SELECT 'F' || l_partkey AS feature_id, max(l_discount) - max(l_tax) AS weight FROM lineitem GROUP BY 1) AS w
 JOIN ({A.FEATURES}) AS f ON w.feature_id = f.feature_id WHERE weight <> 0 OR penalty_factor = 0""")
def _(spark, d):
    w = A.table(spark, d, "lineitem").groupBy(F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("feature_id")).agg((F.max("l_discount") - F.max("l_tax")).alias("weight"))
    return J.drop_unpenalised_zero(w, A.features(spark, d))


@register("min_group_size", f"SELECT * FROM ({A.SAMPLES}) WHERE group_id IN (SELECT group_id FROM ({A.SAMPLES}) GROUP BY 1 HAVING count(*) >= 5)")
def _(spark, d):
    return C.min_group_size(A.samples(spark, d), "group_id", 5)


@register("annotate_genes", f"SELECT a.sample_id, a.feature_id, symbol, value FROM ({A.ASSAY}) AS a JOIN ({A.FEATURES}) AS f ON a.feature_id = f.feature_id WHERE biotype = 'STANDARD'")
def _(spark, d):
    return J.annotate_genes(A.assay(spark, d), A.features(spark, d), "STANDARD")


@register("align_samples", " UNION ALL ".join(f"SELECT * FROM ({A.ASSAY_MOD}) WHERE modality = '{m}'" + "".join(f" AND sample_id IN (SELECT sample_id FROM ({A.ASSAY_MOD}) WHERE modality = '{o}')" for o in "ANR" if o != m) + f" AND sample_id IN (SELECT sample_id FROM ({A.SAMPLES}))" for m in "ANR"))
def _(spark, d):
    a = A.assay_by_modality(spark, d)
    return J.union_cohorts(*J.align_samples(*[a.where(F.col("modality") == m) for m in "ANR"], A.samples(spark, d))[:3])


@register("attach_patient_outcome", f"SELECT sample_barcode AS sample_id, visit, c_mktsegment AS segment FROM ({A.CLINICAL}) JOIN customer ON substr(sample_barcode, 1, 12) = 'P-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')")
def _(spark, d):
    patients = A.table(spark, d, "customer").select(F.concat(F.lit("P-"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("patient_id"), F.col("c_mktsegment").alias("segment"))
    return J.attach_patient_outcome(A.clinical(spark, d).select(F.col("sample_barcode").alias("sample_id"), "visit"), patients).drop("patient_id")


@register("attach_protocol", f"SELECT s.*, n_name AS protocol_name, n_regionkey AS protocol_region FROM ({A.SAMPLES}) AS s LEFT JOIN nation ON group_id = 'G' || n_nationkey")
def _(spark, d):
    n = A.table(spark, d, "nation").select(F.concat(F.lit("G"), F.col("n_nationkey").cast("string")).alias("group_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return J.attach_protocol(A.samples(spark, d), n, key="group_id")


@register("join_labels", f"SELECT a.*, label FROM ({A.ASSAY}) AS a JOIN ({A.SAMPLES}) AS s ON a.sample_id = s.sample_id")
def _(spark, d):
    return J.join_labels(A.assay(spark, d), A.samples(spark, d).select("sample_id", "label"))


@register("concat_modalities", f"SELECT sample_id, modality || ':' || feature_id AS feature_id, value, modality FROM ({A.ASSAY_MOD})")
def _(spark, d):
    a = A.assay_by_modality(spark, d)
    return J.concat_modalities({m: a.where(F.col("modality") == m) for m in ("A", "N", "R")})


@register("late_integration", """SELECT c AS split, u AS sample_id, sum(score * w) / sum(w) AS score, count(*) AS n_models FROM (
 SELECT event_type AS m, 'all' AS c, 'U' || user_id AS u, sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS score, CASE event_type WHEN 'click' THEN 2.0 ELSE 1.0 END AS w
 FROM events GROUP BY 1, 2, 3) AS s GROUP BY 1, 2""", rounded=["score"])
def _(spark, d):
    p = A.scores(spark, d).where("metric = 'roc_auc'").select("model", F.lit("all").alias("split"), F.col("dataset").alias("sample_id"), F.col("value").alias("score"))
    return J.late_integration(p, {"click": 2.0})


@register("merge_split_weights", f"""WITH w AS ({A.SPLIT_WEIGHTS}) SELECT k.model, k.feature_id, s.split, weight FROM (SELECT DISTINCT model, feature_id FROM w) AS k
 JOIN (SELECT DISTINCT model, split FROM w) AS s ON k.model = s.model LEFT JOIN w ON w.model = k.model AND w.feature_id = k.feature_id AND w.split = s.split""")
def _(spark, d):
    return J.merge_split_weights(A.split_weights(spark, d))


@register("merge_risk_scores", f"""WITH p AS (SELECT split AS model, dataset AS split, CAST(label AS VARCHAR) AS sample_id, max(score) AS score FROM ({A.PREDS}) GROUP BY 1, 2, 3)
 SELECT k.model, k.sample_id, s.split, score FROM (SELECT DISTINCT model, sample_id FROM p) AS k JOIN (SELECT DISTINCT model, split FROM p) AS s ON k.model = s.model
 LEFT JOIN p ON p.model = k.model AND p.sample_id = k.sample_id AND p.split = s.split""")
def _(spark, d):
    p = A.predictions(spark, d).groupBy(F.col("split").alias("model"), F.col("dataset").alias("split"), F.col("label").cast("string").alias("sample_id")).agg(F.max("score").alias("score"))
    return J.merge_risk_scores(p)


@register("attach_weights", f"SELECT f.*, weight FROM ({A.FEATURES}) AS f JOIN (SELECT feature_id, max(weight) AS weight FROM ({A.SPLIT_WEIGHTS}) GROUP BY 1) AS w ON f.feature_id = w.feature_id")
def _(spark, d):
    return J.attach_weights(A.features(spark, d), A.split_weights(spark, d).groupBy("feature_id").agg(F.max("weight").alias("weight")))


@register("attach_annotations", f"""SELECT r.*, coalesce(symbol, '') AS symbol, coalesce(brand, '') AS brand FROM (SELECT p_name AS feature_id, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'unknown', 0) AS r
 LEFT JOIN (SELECT p_name AS feature_id, 'F' || p_partkey AS symbol, p_brand AS brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) = 1) AS a ON r.feature_id = a.feature_id""")
def _(spark, d):
    p = A.table(spark, d, "part")
    ann = p.select(F.col("p_name").alias("feature_id"), F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_brand").alias("brand"), "p_partkey")
    counts = p.groupBy(F.col("p_name").alias("feature_id")).agg(F.count(F.lit(1)).alias("n"))
    extra = spark.range(1).select(F.lit("unknown").alias("feature_id"), F.lit(0).cast("bigint").alias("n"))
    return J.attach_annotations(counts.union(extra), ann, ["symbol", "brand", "p_partkey"], [F.col("brand"), F.col("p_partkey")]).drop("p_partkey")


@register("pathway_members_in_assay", f"SELECT * FROM ({A.MEMBERS}) WHERE feature_id IN (SELECT feature_id FROM ({A.ASSAY}))")
def _(spark, d):
    return J.pathway_members_in_assay(A.members(spark, d), A.assay(spark, d))


@register("hierarchy_join", f"SELECT feature_id, m.pathway_id, process_id FROM ({A.MEMBERS}) AS m JOIN ({A.PROCESS}) AS p ON m.pathway_id = p.pathway_id")
def _(spark, d):
    return J.hierarchy_join(A.members(spark, d), A.process_members(spark, d))


@register("paired_by_dataset", f"""WITH s AS (SELECT * FROM ({A.SCORES}) WHERE metric = 'roc_auc') SELECT a.dataset, a.model AS model_a, b.model AS model_b, a.value AS value_a, b.value AS value_b
 FROM s AS a JOIN s AS b ON a.dataset = b.dataset AND a.model < b.model""", rounded=["value_a", "value_b"])
def _(spark, d):
    return J.paired_by_dataset(A.scores(spark, d), "roc_auc")


_PAIRS = f"""WITH s AS ({A.SETS}), n AS (SELECT run, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.run AS run_a, b.run AS run_b, count(*) AS common FROM s AS a JOIN s AS b ON a.item = b.item AND a.run < b.run GROUP BY 1, 2)
 SELECT x.run AS run_a, y.run AS run_b, x.n AS n_a, y.n AS n_b, coalesce(common, 0) AS common, coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)) AS jaccard
 FROM n AS x JOIN n AS y ON x.run < y.run LEFT JOIN c ON c.run_a = x.run AND c.run_b = y.run"""


@register("pairwise_sets", _PAIRS, rounded=["jaccard"])
def _(spark, d):
    return J.pairwise_sets(A.selected_sets(spark, d))


@register("overlap_counts", f"SELECT run_a, run_b, n_a, n_b, common FROM ({_PAIRS})")
def _(spark, d):
    return J.overlap_counts(A.selected_sets(spark, d))


@register("selection_stability", f"SELECT avg(jaccard) AS stability, count(*) AS n_pairs FROM ({_PAIRS})", rounded=["stability"])
def _(spark, d):
    return J.selection_stability(A.selected_sets(spark, d))


@register("jaccard", f"WITH s AS ({A.SETS}) SELECT (SELECT count(*) FROM s AS a JOIN s AS b ON a.item = b.item WHERE a.run = 'click' AND b.run = 'view') / (SELECT count(DISTINCT item) FROM s WHERE run IN ('click', 'view')) AS jaccard", rounded=["jaccard"])
def _(spark, d):
    s = A.selected_sets(spark, d)
    return J.jaccard(s.where("run = 'click'"), s.where("run = 'view'"))


@register("common_ids", f"WITH s AS ({A.SETS}) SELECT item FROM s WHERE run = 'click' INTERSECT SELECT item FROM s WHERE run = 'view' INTERSECT SELECT item FROM s WHERE run = 'error'")
def _(spark, d):
    s = A.selected_sets(spark, d)
    return J.common_ids(*[s.where(F.col("run") == r) for r in ("click", "view", "error")], key="item")


@register("union_cohorts", "SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS price, NULL AS size FROM orders UNION ALL SELECT p_partkey, 'part', NULL, p_size FROM part")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("price"))
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_size").alias("size"))
    return J.union_cohorts(o, p)


@register("model_by_dataset", "SELECT dataset, model FROM (SELECT DISTINCT source AS dataset FROM documents), (SELECT unnest(['logreg', 'svm', 'forest']) AS model)")
def _(spark, d):
    return J.model_by_dataset(["logreg", "svm", "forest"], A.table(spark, d, "documents").select(F.col("source").alias("dataset")).distinct())


@register("distinct_first", f"SELECT * FROM ({A.CLINICAL}) QUALIFY row_number() OVER (PARTITION BY bcr_patient_barcode ORDER BY visit) = 1")
def _(spark, d):
    return C.distinct_first(A.clinical(spark, d), ["bcr_patient_barcode"], [F.col("visit")])


@register("feature_median", f"SELECT feature_id, quantile_cont(value, 0.5) AS median FROM ({A.grid_sql(A.ASSAY)}) GROUP BY 1", rounded=["median"])
def _(spark, d):
    return J.feature_median(A.assay(spark, d))


_COLLAPSE = f"""WITH a AS (SELECT a.sample_id, a.feature_id, symbol, value FROM ({A.ASSAY}) AS a JOIN ({A.FEATURES}) AS f ON a.feature_id = f.feature_id),
 m AS (SELECT symbol, feature_id, quantile_cont(coalesce(a.value, 0.0), 0.5) AS md FROM (SELECT DISTINCT symbol, feature_id FROM a) AS f CROSS JOIN (SELECT DISTINCT sample_id FROM a) AS s LEFT JOIN a USING (symbol, feature_id, sample_id) GROUP BY 1, 2),
 k AS (SELECT feature_id FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY md DESC, feature_id) = 1)
 SELECT sample_id, symbol AS feature_id, value FROM a WHERE feature_id IN (SELECT feature_id FROM k)"""


@register("collapse_duplicate_genes", _COLLAPSE)
def _(spark, d):
    return J.collapse_duplicate_genes(J.annotate_genes(A.assay(spark, d), A.features(spark, d), None))


@register("group_sample_weights", f"SELECT s.*, (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)) / count(*) OVER (PARTITION BY group_id) AS sample_weight FROM ({A.SAMPLES}) AS s", rounded=["sample_weight"])
def _(spark, d):
    return J.group_sample_weights(A.samples(spark, d))


@register("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return J.value_counts(A.table(spark, d, "customer"), "c_mktsegment")


@register("missing_report", f"SELECT 'days_to_death' AS \"column\", count(*) - count(days_to_death) AS missing FROM ({A.CLINICAL}) UNION ALL SELECT 'days_to_last_follow_up', count(*) - count(days_to_last_follow_up) FROM ({A.CLINICAL}) UNION ALL SELECT 'race', count(*) - count(race) FROM ({A.CLINICAL})")
def _(spark, d):
    return J.missing_report(A.clinical(spark, d).select("days_to_death", "days_to_last_follow_up", "race"))


@register("cohort_summary", f"SELECT count(*) AS n_samples, CAST(sum(event) AS BIGINT) AS n_events, avg(event) AS event_rate, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_features FROM ({A.SURVIVAL})", rounded=["event_rate"])
def _(spark, d):
    return J.cohort_summary(A.survival(spark, d), A.assay(spark, d))


_IMP = "SELECT 'F' || l_partkey AS feature_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS importance FROM lineitem GROUP BY 1"


def _importance(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("feature_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("importance"))


@register("top_features", f"SELECT * FROM ({_IMP}) ORDER BY importance DESC, feature_id LIMIT 20")
def _(spark, d):
    return J.top_features(_importance(spark, d), "importance", 20)


@register("top_per_group", f"SELECT i.*, brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY importance DESC, i.feature_id) AS INTEGER) AS rank FROM ({_IMP}) AS i JOIN ({A.FEATURES}) AS f ON i.feature_id = f.feature_id QUALIFY rank <= 5")
def _(spark, d):
    return J.top_per_group(_importance(spark, d).join(A.features(spark, d).select("feature_id", "brand"), "feature_id"), "brand", "importance", 5, "feature_id")


@register("sort_report", f"SELECT * FROM ({A.SCORES}) ORDER BY metric, value DESC, dataset, model", rounded=["value"])
def _(spark, d):
    return J.sort_report(A.scores(spark, d), [F.asc("metric"), F.desc("value"), F.asc("dataset"), F.asc("model")])


@register("union_vital_status", f"""SELECT "Barcode", "OS", CASE "OS" WHEN 'Dead' THEN days_to_death ELSE days_to_last_follow_up END AS "OS_Time" FROM (SELECT {_BASE}{_AJCC} FROM ({RAW})) WHERE "OS" IN ('Dead', 'Alive')""")
def _(spark, d):
    return C.union_vital_status(C.select_clinical(_raw(spark, d), "PAAD")).select("Barcode", "OS", "OS_Time")


@register("os_flag_time", f"""SELECT "Barcode", CASE WHEN "OS" = 'Dead' THEN 1 ELSE 0 END AS "OS", CASE "OS" WHEN 'Dead' THEN days_to_death ELSE days_to_last_follow_up END / 365.0 AS "OS_Time" FROM (SELECT {_BASE}{_AJCC} FROM ({RAW})) WHERE "OS" IN ('Dead', 'Alive')""", rounded=["OS_Time"])
def _(spark, d):
    return C.os_flag_time(C.union_vital_status(C.select_clinical(_raw(spark, d), "PAAD"))).select("Barcode", "OS", "OS_Time")


@register("resolve_survival", f"SELECT visit, CASE WHEN vital_status = 'Dead' THEN 1 ELSE 0 END AS event, CAST(CASE WHEN vital_status = 'Dead' THEN days_to_death ELSE days_to_last_follow_up END AS DOUBLE) AS time FROM ({A.CLINICAL})")
def _(spark, d):
    return C.resolve_survival(A.clinical(spark, d).withColumnRenamed("days_to_last_follow_up", "days_to_last_followup")).select("visit", "event", "time")


@register("cast_outcomes", """SELECT event_id, CAST(value > 5 AS VARCHAR) AS "Status", CAST(user_id AS VARCHAR) AS "Class", TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS "Survival_in_days" FROM events""")
def _(spark, d):
    e = A.table(spark, d, "events").select("event_id", (F.col("value") > 5).alias("Status"), F.col("user_id").alias("Class"),
                                           F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("Survival_in_days"))
    return C.cast_outcomes(e)


@register("age_groups", f"SELECT visit, CASE WHEN age_at_index < 20 THEN '<20' WHEN age_at_index < 50 THEN '20-50' WHEN age_at_index < 70 THEN '50-70' ELSE '>=70' END AS age_group FROM ({A.CLINICAL})")
def _(spark, d):
    return C.age_groups(A.clinical(spark, d), "age_at_index", [20, 50, 70]).select("visit", "age_group")


@register("type_defaults", f"SELECT * FROM ({A.FEATURES}) UNION ALL SELECT DISTINCT c_mktsegment, '', '', '', 0, 0 FROM customer")
def _(spark, d):
    new = A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("feature_id")).distinct()
    return C.type_defaults(A.features(spark, d), new)


@register("map_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Click model' WHEN 'view' THEN 'View model' ELSE event_type END AS event_type FROM events")
def _(spark, d):
    return C.map_names(A.table(spark, d, "events").select("event_id", "event_type"), "event_type", {"click": "Click model", "view": "View model"})


@register("meta_map", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS meta, json_extract_string(props, '$.k') AS k FROM events""")
def _(spark, d):
    e = C.meta_map(A.table(spark, d, "events"), ["event_type", "user_id"])
    return C.meta_get(e, "props", "k", "k").select("event_id", "meta", "k")


_ETL = f"""SELECT translate("Barcode", '-.', '__') AS "Barcode", "Gender", "Race", "Age", CASE WHEN "OS" = 'Dead' THEN 1 ELSE 0 END AS "OS", primary_diagnosis, "Tissue_Origin", pack_years_smoked,
 cigarettes_per_day, "Stage", "T", "N", "M", CASE "OS" WHEN 'Dead' THEN days_to_death ELSE days_to_last_follow_up END / 365.0 AS "OS_Time" FROM (SELECT {_BASE}{_AJCC}, visit FROM ({RAW})
 QUALIFY row_number() OVER (PARTITION BY "Barcode" ORDER BY visit) = 1) WHERE "OS" IN ('Dead', 'Alive')"""


@register("clinical_etl", _ETL, rounded=["OS_Time", "cigarettes_per_day"])
def _(spark, d):
    from cohortia.plans.etl import clinical_etl
    return clinical_etl(_raw(spark, d), "PAAD", [F.col("visit")])


@register("expression_etl", f"""WITH e AS ({_COLLAPSE.replace("f ON a.feature_id = f.feature_id)", "f ON a.feature_id = f.feature_id WHERE biotype = 'STANDARD')")})
 SELECT e.*, label FROM e JOIN ({A.SAMPLES}) AS s ON e.sample_id = s.sample_id""")
def _(spark, d):
    from cohortia.plans.etl import expression_etl
    b = expression_etl(A.assay(spark, d), A.features(spark, d), A.samples(spark, d), "STANDARD")
    return b.assay.select("sample_id", "feature_id", "value").join(b.samples.select("sample_id", "label"), "sample_id")
