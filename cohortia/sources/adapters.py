"""The demo tables seen as the library's logical inputs.

Every adapter has an SQL twin with the same rows, used by the oracle queries. Sums run
over integers (quantities, cents) wherever a later operator ranks or compares them, so
both engines hold identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


ASSAY = """SELECT 'S' || l_suppkey AS sample_id, 'F' || l_partkey AS feature_id, sum(l_quantity) AS value,
 'rna' AS modality FROM lineitem GROUP BY 1, 2"""


def assay(spark, d) -> DataFrame:
    """Counts: supplier = sample, part = feature, summed quantity = value."""
    li = table(spark, d, "lineitem")
    return (
        li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
        .select(_tag("S", "l_suppkey").alias("sample_id"), _tag("F", "l_partkey").alias("feature_id"), "value", F.lit("rna").alias("modality"))
    )


ASSAY_MOD = """SELECT 'S' || l_suppkey AS sample_id, 'F' || l_partkey AS feature_id, sum(l_quantity) AS value,
 l_returnflag AS modality FROM lineitem GROUP BY 1, 2, 4"""


def assay_by_modality(spark, d) -> DataFrame:
    """The same counts with the return flag as modality."""
    li = table(spark, d, "lineitem")
    return (
        li.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("value"))
        .select(_tag("S", "l_suppkey").alias("sample_id"), _tag("F", "l_partkey").alias("feature_id"), "value", F.col("l_returnflag").alias("modality"))
    )


BRAND_ASSAY = """SELECT 'S' || l_suppkey AS sample_id, p_brand AS feature_id, sum(l_quantity) AS value,
 l_returnflag AS modality FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 4"""


def brand_assay(spark, d) -> DataFrame:
    """A narrow, dense assay: supplier x (return flag, brand)."""
    li, pt = table(spark, d, "lineitem"), table(spark, d, "part")
    return (
        li.join(pt.select("p_partkey", "p_brand"), li.l_partkey == pt.p_partkey)
        .groupBy("l_suppkey", "p_brand", "l_returnflag").agg(F.sum("l_quantity").alias("value"))
        .select(_tag("S", "l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature_id"), "value", F.col("l_returnflag").alias("modality"))
    )


FEATURES = """SELECT 'F' || p_partkey AS feature_id, p_name AS symbol, p_type AS biotype, p_brand AS brand,
 p_size AS length, CASE WHEN p_size <= 2 THEN 0 ELSE 1 END AS penalty_factor FROM part"""


def features(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        _tag("F", "p_partkey").alias("feature_id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("biotype"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("length"),
        F.when(F.col("p_size") <= 2, 0).otherwise(1).alias("penalty_factor"),
    )


SAMPLES = """SELECT 'S' || s_suppkey AS sample_id, 'G' || s_nationkey AS group_id, s_acctbal AS balance,
 CASE WHEN s_acctbal > 4000 THEN 1 ELSE 0 END AS label FROM supplier"""


def samples(spark, d) -> DataFrame:
    """Suppliers as samples; class 1 holds the larger balances, nations are replicate groups."""
    return table(spark, d, "supplier").select(
        _tag("S", "s_suppkey").alias("sample_id"), _tag("G", "s_nationkey").alias("group_id"),
        F.col("s_acctbal").alias("balance"), F.when(F.col("s_acctbal") > 4000, 1).otherwise(0).alias("label"),
    )


def grid_sql(src: str, sample: str = "sample_id", feature: str = "feature_id") -> str:
    """Every cell of an assay, absent ones as zeros."""
    return f"""SELECT s.{sample}, f.{feature}, coalesce(c.value, 0.0) AS value FROM (SELECT DISTINCT {sample} FROM ({src})) AS s CROSS JOIN (SELECT DISTINCT {feature} FROM ({src})) AS f
 LEFT JOIN ({src}) AS c ON c.{sample} = s.{sample} AND c.{feature} = f.{feature}"""


MEMBERS = "SELECT p_brand AS pathway_id, 'F' || p_partkey AS feature_id FROM part"


def members(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("pathway_id"), _tag("F", "p_partkey").alias("feature_id"))


PROCESS = "SELECT DISTINCT p_type AS process_id, p_brand AS pathway_id FROM part"


def process_members(spark, d) -> DataFrame:
    """Each brand belongs to every type that one of its parts has."""
    return table(spark, d, "part").select(F.col("p_type").alias("process_id"), F.col("p_brand").alias("pathway_id")).distinct()


SURVIVAL = """SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderpriority AS cohort,
 CAST(date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS time,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, o_totalprice AS score,
 'C' || o_custkey AS group_id FROM orders"""


def survival(spark, d) -> DataFrame:
    """Orders as patients: days to the last order date, event when finished."""
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate")).scalar()
    return o.select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("cohort"),
        F.datediff(last, F.col("o_orderdate")).cast("double").alias("time"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("event"),
        F.col("o_totalprice").alias("score"), _tag("C", "o_custkey").alias("group_id"),
    )


CLINICAL = """SELECT 'P-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS bcr_patient_barcode,
 'P-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '-' ||
   CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '11' ELSE '06' END || 'A' AS sample_barcode,
 CASE WHEN c_acctbal < 4500 THEN 'female' ELSE 'male' END AS gender, c_mktsegment AS race,
 CAST(floor(c_acctbal / 100) AS INTEGER) AS age_at_index,
 CASE o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'O' THEN 'Alive' ELSE 'Not Reported' END AS vital_status,
 CASE WHEN o_orderstatus = 'F' THEN CAST(date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS INTEGER) END AS days_to_death,
 CASE WHEN o_orderstatus <> 'F' THEN CAST(date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS INTEGER) END AS days_to_last_follow_up,
 'NATION_' || c_nationkey AS tissue_or_organ_of_origin, 'D' || c_nationkey AS primary_diagnosis,
 CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN 'i' WHEN '3-MEDIUM' THEN 'i or ii'
   WHEN '4-NOT SPECIFIED' THEN 'NA' ELSE 'iv' END AS tumor_stage,
 o_orderkey AS visit, c_acctbal AS bmi FROM customer JOIN orders ON c_custkey = o_custkey"""

STAGE_OF_PRIORITY = {"1-URGENT": "0", "2-HIGH": "i", "3-MEDIUM": "i or ii", "4-NOT SPECIFIED": "NA"}


def clinical(spark, d) -> DataFrame:
    """Raw clinical rows, one per order, so a patient has duplicates."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate")).scalar()
    days = F.datediff(last, F.col("o_orderdate"))
    done = F.col("o_orderstatus") == "F"
    patient = F.concat(F.lit("P-"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    kind = F.when(done, "01").when(F.col("o_orderstatus") == "O", "11").otherwise("06")
    stage = F.lit("iv")
    for k, v in STAGE_OF_PRIORITY.items():
        stage = F.when(F.col("o_orderpriority") == k, v).otherwise(stage)
    return c.join(o, c.c_custkey == o.o_custkey).select(
        patient.alias("bcr_patient_barcode"), F.concat(patient, F.lit("-"), kind, F.lit("A")).alias("sample_barcode"),
        F.when(F.col("c_acctbal") < 4500, "female").otherwise("male").alias("gender"), F.col("c_mktsegment").alias("race"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("age_at_index"),
        F.when(done, "Dead").when(F.col("o_orderstatus") == "O", "Alive").otherwise("Not Reported").alias("vital_status"),
        F.when(done, days).alias("days_to_death"), F.when(~done, days).alias("days_to_last_follow_up"),
        _tag("NATION_", "c_nationkey").alias("tissue_or_organ_of_origin"), _tag("D", "c_nationkey").alias("primary_diagnosis"),
        stage.alias("tumor_stage"), F.col("o_orderkey").alias("visit"), F.col("c_acctbal").alias("bmi"),
    )


VECS = "SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


DIST = """SELECT u.id_a, u.id_b, d FROM (
 SELECT least(a, b) AS x, greatest(a, b) AS y, CAST(sum(c) AS DOUBLE) / (10.0 * count(*)) AS d FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS a, strftime(l_shipdate, '%Y-%m') AS b,
   CAST(round(l_discount * 100) AS BIGINT) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS s
 WHERE a <> b GROUP BY 1, 2) AS p, LATERAL (SELECT x AS id_a, y AS id_b UNION ALL SELECT y, x) AS u
 UNION ALL SELECT DISTINCT m, m, 0.0 FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders UNION SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem) AS t"""


def distances(spark, d) -> DataFrame:
    """Symmetric distances between calendar months: mean discount of the lines ordered in one and shipped in the other."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    month = lambda c: F.date_format(c, "yyyy-MM")
    pairs = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .select(month("o_orderdate").alias("a"), month("l_shipdate").alias("b"), F.round(F.col("l_discount") * 100).cast("bigint").alias("c"))
        .where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        .agg((F.sum("c").cast("double") / (10.0 * F.count(F.lit(1)))).alias("d"))
    )
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("x").alias("id_a"), F.col("y").alias("id_b"), "d"),
        F.struct(F.col("y").alias("id_a"), F.col("x").alias("id_b"), "d"))).alias("r")).select("r.*")
    ids = o.select(month("o_orderdate").alias("m")).union(li.select(month("l_shipdate"))).distinct()
    return both.unionByName(ids.select(F.col("m").alias("id_a"), F.col("m").alias("id_b"), F.lit(0.0).alias("d")))


PREDS = """SELECT 'length' AS model, source AS dataset, lang AS split, CAST(d.doc_id AS VARCHAR) AS sample_id, quality AS label,
 CAST(n_chars AS DOUBLE) / 200.0 AS score, CASE WHEN n_chars >= 700 THEN 1 ELSE 0 END AS pred,
 CAST(max(n) OVER () AS DOUBLE) / n AS weight FROM (
  SELECT d.*, l.quality, count(*) OVER (PARTITION BY source) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id) AS d"""


def predictions(spark, d) -> DataFrame:
    """Document length as a classifier of quality; weights even out the sources."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    biggest = sizes.agg(F.max("n")).scalar()
    return rows.join(sizes.withColumn("weight", biggest.cast("double") / F.col("n")), "source").select(
        F.lit("length").alias("model"), F.col("source").alias("dataset"), F.col("lang").alias("split"),
        F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").alias("label"),
        (F.col("n_chars").cast("double") / 200.0).alias("score"),
        F.when(F.col("n_chars") >= 700, 1).otherwise(0).alias("pred"), "weight",
    )


SCORES = """SELECT event_type AS model, 'U' || user_id AS dataset, metric, value FROM (
 SELECT event_type, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS roc_auc,
  CAST(max(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS pr_auc FROM events GROUP BY 1, 2) AS e
 UNPIVOT (value FOR metric IN (roc_auc, pr_auc))"""


def scores(spark, d) -> DataFrame:
    """model x dataset x metric: events by type and user."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    agg = table(spark, d, "events").groupBy("event_type", "user_id").agg(
        (F.sum(cents).cast("double") / F.count(F.lit(1))).alias("roc_auc"), F.max(cents).cast("double").alias("pr_auc"))
    return agg.select(F.col("event_type").alias("model"), _tag("U", "user_id").alias("dataset"), "roc_auc", "pr_auc").unpivot(
        ["model", "dataset"], ["roc_auc", "pr_auc"], "metric", "value")


SPLIT_SCORES = """SELECT event_type AS model, 'all' AS dataset, CAST(user_id AS INTEGER) AS split,
 CASE WHEN value < 20 THEN 'cv' ELSE 'te' END AS stage, 'roc_auc' AS metric,
 CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0 AS value FROM events GROUP BY 1, 2, 3, 4"""


def split_scores(spark, d) -> DataFrame:
    """One score per model, split and stage: events by type and user."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, d, "events").groupBy(
        F.col("event_type").alias("model"), F.lit("all").alias("dataset"), F.col("user_id").cast("int").alias("split"),
        F.when(F.col("value") < 20, "cv").otherwise("te").alias("stage"), F.lit("roc_auc").alias("metric"),
    ).agg((F.sum(cents).cast("double") / F.count(F.lit(1)) / 10000.0).alias("value"))


SPLIT_WEIGHTS = """SELECT l_returnflag AS model, 'all' AS dataset, l_linenumber AS split, 'F' || l_partkey AS feature_id,
 max(l_discount) - max(l_tax) AS weight FROM lineitem GROUP BY 1, 2, 3, 4 HAVING max(l_discount) - max(l_tax) <> 0"""


def split_weights(spark, d) -> DataFrame:
    """Feature weights per model and split, zeros dropped: line items by flag and line number."""
    return (
        table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber", "l_partkey")
        .agg((F.max("l_discount") - F.max("l_tax")).alias("weight")).where("weight <> 0")
        .select(F.col("l_returnflag").alias("model"), F.lit("all").alias("dataset"), F.col("l_linenumber").alias("split"),
                _tag("F", "l_partkey").alias("feature_id"), "weight")
    )


CV_RESULTS = """SELECT l_linenumber AS split, CAST(l_discount AS VARCHAR) AS c, CAST(l_tax AS VARCHAR) AS gamma, 'roc_auc' AS metric,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 50.0 AS mean_score,
 max(l_quantity) / 100.0 AS std_score FROM lineitem GROUP BY 1, 2, 3, 4"""


def cv_results(spark, d) -> DataFrame:
    """A search log: split x parameter combination -> mean and std of the score."""
    return table(spark, d, "lineitem").groupBy("l_linenumber", "l_discount", "l_tax").agg(
        (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count(F.lit(1)) / 50.0).alias("mean_score"),
        (F.max("l_quantity") / 100.0).alias("std_score"),
    ).select(
        F.col("l_linenumber").alias("split"),
        F.create_map(F.lit("c"), F.col("l_discount").cast("string"), F.lit("gamma"), F.col("l_tax").cast("string")).alias("params"),
        F.lit("roc_auc").alias("metric"), "mean_score", "std_score",
    )


SETS = """SELECT run, item FROM (SELECT event_type AS run, 'U' || user_id AS item, sum(CAST(round(value * 100) AS BIGINT)) AS s, count(*) AS n,
 sum(sum(CAST(round(value * 100) AS BIGINT))) OVER (PARTITION BY event_type) AS total, sum(count(*)) OVER (PARTITION BY event_type) AS size FROM events GROUP BY 1, 2) AS t WHERE s * size > total * n"""


def selected_sets(spark, d) -> DataFrame:
    """Features picked by each run: users whose mean event lies above the mean of the type."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("event_type").agg(F.sum("s").alias("total"), F.sum("n").alias("size"))
    return per.join(whole, "event_type").where("s * size > total * n").select(F.col("event_type").alias("run"), _tag("U", "user_id").alias("item"))
