"""File formats: each query writes what Spark derives from the tables to the shared folder and reads it back."""

import uuid

from pyspark.sql import functions as F

from cohortia.catalog.registry import register
from cohortia.session import shared_dir
from cohortia.sources import adapters as A
from cohortia.sources import bundle as B
from cohortia.sources import readers as R


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("read_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    path = _path(spark, "table")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    A.table(spark, d, "orders").select(*cols).write.option("header", True).option("sep", "\t").csv(path)
    return R.read_table(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double", "\t")


_WIDE = f"SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2"


@register("read_matrix_long", f"SELECT s.sample_id, f.feature_id, value FROM (SELECT DISTINCT sample_id FROM ({_WIDE})) AS s JOIN (SELECT DISTINCT p_brand AS feature_id FROM part) AS f ON true LEFT JOIN ({_WIDE}) AS w ON w.sample_id = s.sample_id AND w.feature_id = f.feature_id")
def _(spark, d):
    brands = [r[0] for r in A.table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    wide = R.pivot_wide(A.brand_assay(spark, d), brands)
    path = _path(spark, "matrix")
    wide.write.option("header", True).option("nullValue", "NA").csv(path)
    return R.read_matrix_long(spark, path, ",", "samples_x_features")


@register("read_distance_matrix", f"WITH t AS ({A.DIST}), i AS (SELECT DISTINCT id_a AS id FROM t) SELECT a.id AS id_a, b.id AS id_b, coalesce(d, 1.0) AS d FROM i AS a JOIN i AS b ON true LEFT JOIN t ON t.id_a = a.id AND t.id_b = b.id", rounded=["d"])
def _(spark, d):
    dist = A.distances(spark, d)
    ids = [r[0] for r in dist.select("id_a").distinct().orderBy("id_a").collect()]
    square = dist.groupBy("id_a").agg(*[F.coalesce(F.max(F.when(F.col("id_b") == i, F.col("d"))), F.lit(1.0)).alias(i) for i in ids])
    path = _path(spark, "distance")
    # The format is one file whose row order is the header order; it holds one row per id.
    square.orderBy("id_a").coalesce(1).drop("id_a").write.option("header", True).csv(path)
    return R.read_distance_matrix(spark, path)


@register("bundle_read", f"SELECT * FROM ({A.ASSAY_MOD})")
def _(spark, d):
    path = _path(spark, "bundle")
    B.bundle_write(B.CohortBundle(A.assay_by_modality(spark, d), A.samples(spark, d), A.features(spark, d), {"cancer": "demo"}), path)
    return B.bundle_read(spark, path).assay


@register("bundle_default_names", "SELECT 'Sample_' || l_suppkey AS sample_id, 'Feature_' || l_partkey AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    cells = A.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
    return B.default_names(cells, "l_suppkey", "l_partkey").select("sample_id", "feature_id", "value")


@register("write_results", f"SELECT model, dataset, metric, value FROM ({A.SCORES})", rounded=["value"])
def _(spark, d):
    path = _path(spark, "results")
    R.write_results(A.scores(spark, d), path, "tsv")
    return R.read_table(spark, path, "model string, dataset string, metric string, value double", "\t")
