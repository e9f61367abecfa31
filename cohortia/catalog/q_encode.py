"""Sources, encodings and normalisation."""

from pyspark.sql import functions as F

from cohortia.catalog.registry import register
from cohortia.operators import encode as E
from cohortia.operators import normalise as N
from cohortia.session import cut_lineage
from cohortia.sources import adapters as A
from cohortia.sources import readers as R

@register("read_gene_sets", "SELECT source AS pathway_id, CAST(doc_id AS VARCHAR) AS feature_id FROM documents")
def _(spark, d):
    docs = A.table(spark, d, "documents").groupBy("source", F.col("lang")).agg(F.array_join(F.collect_list(F.col("doc_id").cast("string")), ", ").alias("g"))
    return R.parse_gene_sets(docs.select(F.concat("source", F.lit("\t"), "g").alias("value")))


@register("read_gtf_genes", "SELECT 'F' || p_partkey AS gene_id, p_name AS gene_name, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS gene_type FROM part WHERE p_size > 10")
def _(spark, d):
    p = A.table(spark, d, "part")
    kind = F.when(F.col("p_size") > 10, "gene").otherwise("exon")
    line = F.concat(F.lit("1\tdemo\t"), kind, F.lit('\t1\t9\t.\t+\t.\tgene_id "F'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), "p_name", F.lit('";'),
                    F.when(F.col("p_size") > 25, F.concat(F.lit(' gene_type "'), "p_type", F.lit('";'))).otherwise(""))
    return R.parse_gtf_genes(p.select(line.alias("value")))


@register("discover_datasets", r"""WITH u AS (SELECT url AS name, string_split(regexp_extract(url, '([^/]+?)(?:\.[A-Za-z0-9]+)?$', 1), '_') AS p FROM (
 SELECT page_id, 's3/tcga_' || regexp_extract(url, '/(..)/', 1) || '_resp_t' || page_id || '_' || regexp_extract(url, 'example.(com|org|net)', 1) || '_x.rds' AS url FROM pages))
 SELECT name, p[2] AS cancer, p[3] AS analysis, p[4] AS target, p[5] AS source FROM u WHERE len(p) >= 5 AND p[2] IN ('en', 'fr') AND p[5] IN ('com', 'org')""")
def _(spark, d):
    p = A.table(spark, d, "pages")
    name = F.concat(F.lit("s3/tcga_"), F.regexp_extract("url", "/(..)/", 1), F.lit("_resp_t"), F.col("page_id").cast("string"), F.lit("_"), F.regexp_extract("url", "example.(com|org|net)", 1), F.lit("_x.rds"))
    return R.discover_datasets(p.select(name.alias("name")), ["en", "fr"], ["resp"], ["com", "org"])


@register("matrix_to_vectors", f"""WITH a AS (SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2), k AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS i FROM (SELECT DISTINCT feature_id FROM a))
 SELECT s.sample_id, CAST(k.i AS BIGINT) AS position, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT sample_id FROM a) AS s, k LEFT JOIN a ON a.sample_id = s.sample_id AND a.feature_id = k.feature_id""")
def _(spark, d):
    a = A.brand_assay(spark, d).groupBy("sample_id", "feature_id").agg(F.sum("value").alias("value"))
    v = R.matrix_to_vectors(a, R.feature_index(a))
    return v.select("sample_id", F.posexplode("vec").alias("position", "value")).withColumn("position", F.col("position").cast("bigint"))


@register("pivot_wide", f"""SELECT sample_id, sum(CASE WHEN feature_id = 'Brand#1' THEN value END) AS "Brand#1", sum(CASE WHEN feature_id = 'Brand#2' THEN value END) AS "Brand#2" FROM ({A.BRAND_ASSAY}) GROUP BY 1""")
def _(spark, d):
    return R.pivot_wide(A.brand_assay(spark, d), ["Brand#1", "Brand#2"])


@register("ordinal_encode", f"SELECT visit, CASE tumor_stage WHEN '0' THEN 0 WHEN 'i' THEN 1 WHEN 'i or ii' THEN 2 WHEN 'NA' THEN 4 ELSE 6 END AS tumor_stage FROM ({A.CLINICAL})")
def _(spark, d):
    return E.ordinal_encode(A.clinical(spark, d).select("visit", "tumor_stage"), "tumor_stage")


@register("stage_to_int", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 3 END AS stage FROM part")
def _(spark, d):
    s = F.when(F.col("p_size") < 10, "I").when(F.col("p_size") < 20, "II").when(F.col("p_size") < 30, "IV").otherwise("unknown")
    return E.stage_to_int(A.table(spark, d, "part").select("p_partkey", s.alias("stage")), "stage")


@register("response_to_int", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'error' THEN 0 END AS response FROM events")
def _(spark, d):
    r = F.when(F.col("event_type") == "click", "Positive").when(F.col("event_type") == "view", "NO").when(F.col("event_type") == "error", "non-responsive").otherwise("maybe")
    return E.response_to_int(A.table(spark, d, "events").select("event_id", r.alias("response")), "response")


@register("one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v.replace(' ', '_')}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")) + " FROM orders")
def _(spark, d):
    return E.one_hot(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", na="4-NOT SPECIFIED")


@register("dummy_encode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS \"o_orderstatus_O\", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS \"o_orderstatus_P\" FROM orders")
def _(spark, d):
    return E.dummy_encode(A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@register("impute", f"""WITH c AS ({A.CLINICAL}), m AS (SELECT quantile_cont(days_to_death, 0.5) AS q FROM c), r AS (SELECT race FROM c WHERE gender = 'male' GROUP BY 1 ORDER BY count(*) DESC, race LIMIT 1)
 SELECT visit, coalesce(CAST(days_to_death AS DOUBLE), (SELECT q FROM m)) AS days_to_death, CASE WHEN gender = 'male' THEN race ELSE (SELECT race FROM r) END AS race FROM c""", rounded=["days_to_death"])
def _(spark, d):
    c = A.clinical(spark, d).select("visit", "days_to_death", F.when(F.col("gender") == "male", F.col("race")).alias("race"))
    return E.impute(c, ["days_to_death"], ["race"])


@register("standardise", f"""SELECT sample_id, feature_id, z AS value, 'rna' AS modality FROM (SELECT *, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-9 THEN stddev_pop(value) OVER w ELSE 1 END AS z
 FROM ({A.grid_sql(A.ASSAY)}) WINDOW w AS (PARTITION BY feature_id)) WHERE value <> 0""", rounded=["value"])
def _(spark, d):
    return E.standardise(A.assay(spark, d))


@register("label_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def _(spark, d):
    return E.label_encode(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


@register("normalize_total_log1p", f"SELECT sample_id, feature_id, ln(1 + value / sum(value) OVER (PARTITION BY sample_id) * 10000) AS value, modality FROM ({A.ASSAY})", rounded=["value"])
def _(spark, d):
    return N.normalize_total_log1p(A.assay(spark, d))


@register("relative_abundance", f"SELECT sample_id, feature_id, value / sum(value) OVER (PARTITION BY sample_id) AS value, modality FROM ({A.ASSAY})", rounded=["value"], digits=9)
def _(spark, d):
    return N.relative_abundance(A.assay(spark, d))


@register("clr", f"SELECT sample_id, feature_id, z AS value, 'rna' AS modality FROM (SELECT *, ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY sample_id) AS z FROM ({A.grid_sql(A.ASSAY)})) WHERE value <> 0", rounded=["value"])
def _(spark, d):
    return N.clr(A.assay(spark, d))


@register("prevalence_filter", f"""SELECT * FROM ({A.ASSAY}) WHERE feature_id IN (SELECT feature_id FROM ({A.ASSAY}) GROUP BY 1 HAVING count(*) FILTER (WHERE value >= 10) >= 0.2 * (SELECT count(DISTINCT l_suppkey) FROM lineitem))""")
def _(spark, d):
    return N.prevalence_filter(A.assay(spark, d), 10, 0.2)


@register("tpm", f"""SELECT sample_id, feature_id, r / sum(r) OVER (PARTITION BY sample_id) * 1e6 AS value, modality FROM (SELECT a.*, value / length AS r FROM ({A.ASSAY}) AS a JOIN ({A.FEATURES}) AS f ON a.feature_id = f.feature_id)""", rounded=["value"], digits=4)
def _(spark, d):
    return N.tpm(A.assay(spark, d), A.features(spark, d))


@register("aggregate_features", f"SELECT sample_id, pathway_id AS feature_id, sum(value) AS value FROM ({A.ASSAY}) AS a JOIN ({A.MEMBERS}) AS m ON a.feature_id = m.feature_id GROUP BY 1, 2")
def _(spark, d):
    return N.aggregate_features(A.assay(spark, d), A.members(spark, d).select("feature_id", F.col("pathway_id").alias("group_id")))


@register("feature_distribution", f"""SELECT feature_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.75) AS q75 FROM ({A.grid_sql(A.ASSAY)}) GROUP BY 1""", rounded=["mean", "std", "q25", "median", "q75"])
def _(spark, d):
    return N.feature_distribution(A.assay(spark, d))


_FBE = f"""WITH a AS (SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2), l AS (SELECT sample_id, sum(value) AS lib FROM a GROUP BY 1),
 z AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ({A.SAMPLES}) WHERE sample_id IN (SELECT sample_id FROM l) GROUP BY label)), c AS (SELECT a.feature_id, count(*) FILTER (WHERE value / lib * 1e6 >= {{count}}.0 / (SELECT quantile_cont(lib, 0.5) FROM l) * 1e6) AS n, sum(value) AS t
 FROM a JOIN l ON a.sample_id = l.sample_id GROUP BY 1) SELECT * FROM a WHERE feature_id IN (SELECT feature_id FROM c, (SELECT CASE WHEN n > 10 THEN 10 + 0.7 * (n - 10) ELSE n END AS k FROM z) WHERE c.n >= k - 1e-9 AND t >= 15)"""


def _brand_counts(spark, d):
    return cut_lineage(A.brand_assay(spark, d).groupBy("sample_id", "feature_id").agg(F.sum("value").alias("value")))


@register("filter_by_expr", _FBE.format(count=600))
def _(spark, d):
    return N.filter_by_expr(_brand_counts(spark, d), A.samples(spark, d), min_count=600)


_TMM = f"""WITH a AS (SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2), l AS (SELECT sample_id, sum(value) AS lib FROM a GROUP BY 1),
 u AS (SELECT g.sample_id, quantile_cont(value / lib, 0.75) AS uq FROM ({A.grid_sql("SELECT * FROM a")}) AS g JOIN l ON g.sample_id = l.sample_id GROUP BY 1),
 r AS (SELECT sample_id FROM u ORDER BY round(abs(uq - (SELECT avg(uq) FROM u)), 12), sample_id LIMIT 1),
 f AS (SELECT feature_id, value AS r, lib AS nr FROM a JOIN l ON a.sample_id = l.sample_id WHERE a.sample_id = (SELECT sample_id FROM r)),
 c AS (SELECT a.sample_id, log2(value / lib) - log2(r / nr) AS m, (log2(value / lib) + log2(r / nr)) / 2 AS a, (lib - value) / lib / value + (nr - r) / nr / r AS v FROM a JOIN l ON a.sample_id = l.sample_id JOIN f ON f.feature_id = a.feature_id),
 k AS (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY m) + (count(*) OVER (PARTITION BY sample_id, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY sample_id ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, a) - 1) / 2.0 AS ra,
  count(*) OVER (PARTITION BY sample_id) AS n FROM c),
 w AS (SELECT sample_id, sum(m / v) / sum(1 / v) AS lf FROM k WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY 1),
 t AS (SELECT l.sample_id, lib, coalesce(lf, 0.0) AS lf FROM l LEFT JOIN w ON l.sample_id = w.sample_id) SELECT sample_id, lib, pow(2, lf - (SELECT avg(lf) FROM t)) AS factor FROM t"""


TMM_SQL = _TMM


@register("tmm_factors", _TMM, rounded=["factor"])
def _(spark, d):
    return N.tmm_factors(_brand_counts(spark, d))


@register("log_cpm", f"""SELECT a.sample_id, a.feature_id, log2((value + e / m) / (e + 2 * e / m) * 1e6) AS value FROM
 ({A.grid_sql(f"SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2")}) AS a JOIN (SELECT sample_id, lib * factor AS e, avg(lib * factor) OVER () AS m FROM ({_TMM})) AS f ON a.sample_id = f.sample_id""", rounded=["value"])
def _(spark, d):
    a = _brand_counts(spark, d)
    return N.log_cpm(a, N.tmm_factors(a))
