"""Statistics and tests, including the flagship query."""

from functools import reduce

from pyspark.sql import functions as F

from cohortia.catalog import tails_sql
from cohortia.catalog.q_encode import TMM_SQL
from cohortia.catalog.registry import register
from cohortia.operators import normalise as N
from cohortia.operators import stats as T
from cohortia.operators.joins import top_features
from cohortia.session import cut_lineage
from cohortia.sources import adapters as A

_MOM = """WITH g AS (SELECT sample_id, label FROM ({samples})), n AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM g WHERE sample_id IN (SELECT sample_id FROM ({src}))),
 j AS (SELECT a.feature_id, value, label FROM ({src}) AS a JOIN g ON a.sample_id = g.sample_id),
 m AS (SELECT feature_id, {n1} AS n1, {n0} AS n0, sum(CASE WHEN label = 1 THEN value ELSE 0 END) AS s1, sum(CASE WHEN label = 0 THEN value ELSE 0 END) AS s0,
  sum(CASE WHEN label = 1 THEN value * value ELSE 0 END) AS q1, sum(CASE WHEN label = 0 THEN value * value ELSE 0 END) AS q0 FROM j GROUP BY 1),
 v AS (SELECT feature_id, n1, n0, CASE WHEN n1 > 0 THEN s1 / n1 END AS mean1, CASE WHEN n0 > 0 THEN s0 / n0 END AS mean0,
  CASE WHEN n1 > 1 THEN greatest(q1 - s1 * s1 / n1, 0) / (n1 - 1) END AS var1, CASE WHEN n0 > 1 THEN greatest(q0 - s0 * s0 / n0, 0) / (n0 - 1) END AS var0 FROM m)"""
_WELCH = """, w AS (SELECT *, CASE WHEN var1 / n1 + var0 / n0 > 1e-12 THEN var1 / n1 + var0 / n0 END AS se2, sqrt((var1 + var0) / 2) AS pooled FROM v)
 SELECT feature_id, n1, n0, mean1, mean0, mean1 - mean0 AS diff, (mean1 - mean0) / sqrt(se2) AS t, se2 * se2 / ((var1 / n1) * (var1 / n1) / (n1 - 1) + (var0 / n0) * (var0 / n0) / (n0 - 1)) AS df,
 CASE WHEN pooled > 1e-12 THEN (mean1 - mean0) / pooled ELSE 0 END AS d FROM w"""
_PRESENT = {"n1": "count(*) FILTER (WHERE label = 1)", "n0": "count(*) FILTER (WHERE label = 0)"}
_ZERO = {"n1": "(SELECT n1 FROM n)", "n0": "(SELECT n0 FROM n)"}
_NORM = f"SELECT sample_id, feature_id, ln(1 + value / sum(value) OVER (PARTITION BY sample_id) * 10000) AS value, modality FROM ({A.ASSAY})"
_FLAGSHIP = _MOM.format(src=_NORM, samples=A.SAMPLES, **_ZERO) + _WELCH
_COLS = ["mean1", "mean0", "diff", "t", "df", "d"]


def _measured(spark, d):
    return A.table(spark, d, "lineitem").select("l_suppkey").distinct().select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample_id"))


def _welch_norm(spark, d):
    return T.welch_t(N.normalize_total_log1p(A.assay(spark, d)), A.samples(spark, d), zero_fill=True, measured=_measured(spark, d))


@register("flagship", f"SELECT feature_id, abs(d) AS effect, diff, t FROM ({_FLAGSHIP}) ORDER BY round(abs(d), 9) DESC, feature_id LIMIT 20", rounded=["diff", "t", "effect"])
def _(spark, d):
    w = _welch_norm(spark, d).select("feature_id", F.abs("d").alias("effect"), "diff", "t", F.round(F.abs("d"), 9).alias("by"))
    return top_features(w, "by", 20).drop("by")


@register("welch_t", _FLAGSHIP, rounded=_COLS, digits=5)
def _(spark, d):
    return _welch_norm(spark, d).drop("p", "significant")


@register("welch_t_pvalues", f"SELECT *, coalesce(p < 0.05, false) AS significant FROM (SELECT *, {tails_sql.t_two_sided('t', 'df')} AS p FROM ({_FLAGSHIP}))", rounded=[*_COLS, "p"], digits=5)
def _(spark, d):
    return T.sort_tests(_welch_norm(spark, d))


_MODAL = f"SELECT sample_id, modality || ':' || feature_id AS feature_id, value FROM ({A.BRAND_ASSAY})"


def _modal(spark, d):
    """Every modality's features under names of their own."""
    return A.brand_assay(spark, d).select("sample_id", F.concat_ws(":", "modality", "feature_id").alias("feature_id"), "value")


@register("group_mean_difference", _MOM.format(src=_MODAL, samples=A.SAMPLES, **_PRESENT) + " SELECT feature_id, mean1, mean0, mean1 - mean0 AS diff, abs(mean1 - mean0) AS abs_diff FROM v", rounded=["mean1", "mean0", "diff", "abs_diff"])
def _(spark, d):
    return T.group_mean_difference(_modal(spark, d), A.samples(spark, d))


_CUST = "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label, c_acctbal AS v, c_nationkey AS grp FROM customer"
_PERM = """WITH c AS (SELECT *{value} FROM ({cust})), k AS (SELECT grp, sum(label) AS n1 FROM c GROUP BY 1), p AS (SELECT r, x, CASE WHEN row_number() OVER (PARTITION BY r, c.grp ORDER BY md5('777|' || r || '|' || sample_id)) <= n1 THEN 1 ELSE 0 END AS y FROM c JOIN k ON c.grp = k.grp, (SELECT unnest(range(1, 1001)) AS r)),
 b AS (SELECT r, x, y FROM p UNION ALL SELECT 0, x, label FROM c), s AS (SELECT r, {stat} AS st FROM b GROUP BY 1) SELECT (SELECT st FROM s WHERE r = 0) AS "true", avg(st) FILTER (WHERE r > 0) AS mean_permuted, (count(*) FILTER (WHERE r > 0 AND st >= (SELECT st FROM s WHERE r = 0) - 1e-12) + 1) / 1001.0 AS p FROM s"""


def _customers(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("label"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("grp"))


@register("permutation_test", _PERM.format(value=", v AS x", cust=_CUST, stat="sum(x * y) / sum(y) - sum(x * (1 - y)) / sum(1 - y)"), rounded=["true", "mean_permuted", "p"])
def _(spark, d):
    return T.permutation_test(_customers(spark, d), "v", 1000, "grp")


@register("permutation_test_auc", _PERM.format(value=", rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS x", cust=_CUST.replace("c_nationkey AS grp", "0 AS grp"), stat="(sum(x * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))"), rounded=["true", "mean_permuted", "p"])
def _(spark, d):
    return T.permutation_test(_customers(spark, d), "v", 1000, None, statistic="auc")


_AB = f"SELECT a.sample_id, a.modality || b.modality || ':' || a.feature_id AS feature_id, a.value AS x, b.value AS y FROM ({A.BRAND_ASSAY}) AS a JOIN ({A.BRAND_ASSAY}) AS b ON a.sample_id = b.sample_id AND a.feature_id = b.feature_id WHERE a.modality < b.modality"


def _ab(spark, d):
    a = A.brand_assay(spark, d)
    return a.where("modality = 'A'"), a.where("modality = 'R'")


def _all_pairs(spark, d):
    """Both sides of every pair of modalities, the pair in the feature name."""
    a = A.brand_assay(spark, d)
    name = lambda side, pair: side.select("sample_id", F.concat(F.lit(pair + ":"), "feature_id").alias("feature_id"), "value")
    parts = {m: a.where(F.col("modality") == m) for m in "ANR"}
    left, right = zip(*[(name(parts[p[0]], p), name(parts[p[1]], p)) for p in ("AN", "AR", "NR")])
    return reduce(lambda x, y: x.unionByName(y), left), reduce(lambda x, y: x.unionByName(y), right)


@register("pearson_by_feature", f"SELECT feature_id, count(*) AS n, corr(x, y) AS r FROM ({_AB}) GROUP BY 1", rounded=["r"])
def _(spark, d):
    return T.pearson_by_feature(*_all_pairs(spark, d))


@register("spearman_by_feature", f"""SELECT feature_id, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT feature_id, rank() OVER (PARTITION BY feature_id ORDER BY x) + (count(*) OVER (PARTITION BY feature_id, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY feature_id ORDER BY y) + (count(*) OVER (PARTITION BY feature_id, y) - 1) / 2.0 AS ry FROM ({_AB})) GROUP BY 1""", rounded=["rho"])
def _(spark, d):
    return T.spearman_by_feature(*_all_pairs(spark, d))


@register("feature_cross_correlation", f"""SELECT a.feature_id AS feature_a, b.feature_id AS feature_b, count(*) AS n, corr(a.value, b.value) AS r FROM ({A.BRAND_ASSAY}) AS a JOIN ({A.BRAND_ASSAY}) AS b ON a.sample_id = b.sample_id
 WHERE a.modality = 'A' AND b.modality = 'R' AND a.feature_id IN ('Brand#1', 'Brand#2', 'Brand#3') AND b.feature_id IN ('Brand#4', 'Brand#5') GROUP BY 1, 2""", rounded=["r"])
def _(spark, d):
    a, b = _ab(spark, d)
    return T.feature_cross_correlation(a, b, ["Brand#1", "Brand#2", "Brand#3"], ["Brand#4", "Brand#5"])


_CA = f"SELECT a.modality || ':' || a.feature_id AS feature_id, value, balance, CASE WHEN balance < 3000 THEN 'low' WHEN balance < 7000 THEN 'mid' ELSE 'high' END AS grp FROM ({A.BRAND_ASSAY}) AS a JOIN ({A.SAMPLES}) AS s ON a.sample_id = s.sample_id"


@register("clinical_association", f"""WITH j AS ({_CA}), c AS (SELECT feature_id, grp, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM j GROUP BY 1, 2), s AS (SELECT feature_id, sum(c) AS n, count(*) AS k, sum(c * m) / sum(c) AS gm, sum(c * v) AS wi, sum(c * m * m) AS q FROM c GROUP BY 1)
 SELECT feature_id, 'balance' AS covariate, 'r' AS kind, count(*) AS n, corr(value, balance) AS stat FROM j GROUP BY 1
 UNION ALL SELECT feature_id, 'grp', 'F', CAST(n AS BIGINT), CASE WHEN k > 1 AND n > k AND wi > 0 THEN (q - n * gm * gm) / (k - 1) / (wi / (n - k)) END FROM s""", rounded=["stat"], digits=5)
def _(spark, d):
    s = A.samples(spark, d).withColumn("grp", F.when(F.col("balance") < 3000, "low").when(F.col("balance") < 7000, "mid").otherwise("high"))
    return T.clinical_association(_modal(spark, d), s, ["balance"], ["grp"]).drop("p")


@register("latent_entropy", "WITH c AS (SELECT count(*) AS c FROM embeddings GROUP BY label), p AS (SELECT c / (SELECT sum(c) FROM c) AS p FROM c) SELECT count(*) AS k, -sum(p * ln(p)) AS entropy, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM p", rounded=["entropy", "evenness"])
def _(spark, d):
    return T.latent_entropy(A.table(spark, d, "embeddings"))


@register("mse", f"SELECT substr(feature_id, 1, 2) AS modality, avg((x - y) * (x - y)) AS mse, count(*) AS n FROM ({_AB}) GROUP BY 1", rounded=["mse"])
def _(spark, d):
    a, b = _all_pairs(spark, d)
    return T.mse(a.withColumn("modality", F.substring("feature_id", 1, 2)), b)


@register("adjusted_rand", """WITH j AS (SELECT source AS a, lang AS b, count(*) AS n FROM documents GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2.0) AS i FROM j), a AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM j GROUP BY a)),
 b AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM j GROUP BY b)), t AS (SELECT sum(n) AS n FROM j) SELECT CAST(n AS BIGINT) AS n, (i - a.s * b.s / (n * (n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (n * (n - 1) / 2.0)) AS ari FROM i, a, b, t""", rounded=["ari"])
def _(spark, d):
    doc = A.table(spark, d, "documents")
    return T.adjusted_rand(doc.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("label")), doc.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("label")))


def _log_brand(spark, d):
    a = cut_lineage(A.brand_assay(spark, d).groupBy("sample_id", "feature_id").agg(F.sum("value").alias("value")))
    return a, N.log_cpm(a, N.tmm_factors(a))


@register("limma_ordinary_t", _MOM.format(src=_NORM, samples=A.SAMPLES, **_ZERO) + """ SELECT feature_id, mean1 - mean0 AS log_fc, CASE WHEN s2 > 1e-12 THEN (mean1 - mean0) / sqrt(s2) / sqrt(1 / n1 + 1 / n0) END AS t_ordinary
 FROM (SELECT *, (var1 * (n1 - 1) + var0 * (n0 - 1)) / (n1 + n0 - 2) AS s2 FROM v)""", rounded=["log_fc", "t_ordinary"], digits=5)
def _(spark, d):
    t = T.limma_moderated_t(N.normalize_total_log1p(A.assay(spark, d)), A.samples(spark, d), zero_fill=True, measured=_measured(spark, d))
    return t.select("feature_id", "log_fc", "t_ordinary")


@register("limma_moderated_t")
def _(spark, d):
    return T.limma_moderated_t(_log_brand(spark, d)[1], A.samples(spark, d))


_SCALED = f"""SELECT a.sample_id, a.feature_id, value / e * m AS value FROM (SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2) AS a
 JOIN (SELECT sample_id, lib * factor AS e, avg(lib * factor) OVER () AS m FROM ({TMM_SQL})) AS f ON a.sample_id = f.sample_id"""
_EDGER = _MOM.format(src=_SCALED, samples=A.SAMPLES, **_ZERO) + f""", b AS (SELECT *, n1 + n0 - 2 AS df, (mean1 * n1 + mean0 * n0) / (n1 + n0) AS mu, (var1 * (n1 - 1) + var0 * (n0 - 1)) / (n1 + n0 - 2) AS s2 FROM v WHERE n1 > 1 AND n0 > 1),
 w AS (SELECT *, greatest((s2 - mu) / (mu * mu), 0) AS raw FROM b WHERE mu > 0), c AS (SELECT *, sum(raw * mu) OVER () / sum(mu) OVER () AS common FROM w),
 x AS (SELECT *, CASE WHEN raw > 4 * common THEN raw ELSE (df * raw + 10 * common) / (df + 10) END AS dispersion FROM c),
 z AS (SELECT feature_id, mean1, mean0, dispersion, ln((mean1 + 1) / (mean0 + 1)) / ln(2) AS log_fc, ln((mean1 + 1) / (mean0 + 1)) / sqrt((1 / (mean1 + 1) + dispersion) / n1 + (1 / (mean0 + 1) + dispersion) / n0) AS z FROM x)
 SELECT *, {tails_sql.normal_two_sided('z')} AS p FROM z"""


@register("edger_two_group", _EDGER, rounded=["mean1", "mean0", "dispersion", "log_fc", "z", "p"], digits=5)
def _(spark, d):
    a = cut_lineage(A.brand_assay(spark, d).groupBy("sample_id", "feature_id").agg(F.sum("value").alias("value")))
    return T.edger_two_group(a, A.samples(spark, d), N.tmm_factors(a))
