"""Vectors, distances, clusters, graphs and pathways."""

from pyspark.sql import functions as F

from cohortia.catalog import tails_sql
from cohortia.catalog.registry import register
from cohortia.operators import cluster as C
from cohortia.operators import graph as G
from cohortia.operators import pathway as P
from cohortia.operators import vectors as V
from cohortia.operators.encode import standardise, standardised_zero
from cohortia.session import cut_lineage
from cohortia.sources import adapters as A
from cohortia.sources import readers as R

_SIM = f"v AS ({A.VECS}), p AS (SELECT a.sample_id AS id_a, b.sample_id AS id_b, list_cosine_similarity(a.vec, b.vec) AS similarity FROM v AS a JOIN v AS b ON a.sample_id <> b.sample_id)"
_NN = _SIM + ", k AS (SELECT id_a, id_b, similarity, CAST(row_number() OVER (PARTITION BY id_a ORDER BY round(similarity, 12) DESC, id_b) AS INTEGER) AS rank FROM p QUALIFY rank <= 10)"


@register("cosine", "SELECT label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS similarity FROM embeddings", rounded=["similarity"])
def _(spark, d):
    e = A.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    first = e.agg(F.min_by("vec", "vec_id")).scalar()
    return e.withColumn("ref", first).select("label", "vec_id", V.cosine("vec", "ref").alias("similarity"))


@register("euclidean", "SELECT label, vec_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS d FROM embeddings", rounded=["d"])
def _(spark, d):
    e = A.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    first = e.agg(F.min_by("vec", "vec_id")).scalar()
    return e.withColumn("ref", first).select("label", "vec_id", V.euclidean("vec", "ref").alias("d"))


@register("nearest_k", f"WITH {_NN} SELECT * FROM k", rounded=["similarity"])
def _(spark, d):
    return V.nearest_k(A.vectors(spark, d), 10)


@register("similarity_self_join", f"WITH {_SIM} SELECT * FROM p WHERE similarity > 0.2 AND id_a < id_b", rounded=["similarity"])
def _(spark, d):
    return V.similarity_self_join(A.vectors(spark, d), 0.2)


@register("threshold_graph", f"WITH {_SIM} SELECT id_a AS src, id_b AS dst, similarity AS weight FROM p WHERE similarity > 0.25", rounded=["weight"])
def _(spark, d):
    return G.threshold_graph(A.vectors(spark, d), 0.25)


_KNN = f"WITH {_NN} SELECT src, dst, max(weight) AS weight FROM (SELECT id_a AS src, id_b AS dst, similarity AS weight FROM k WHERE similarity > 0 UNION ALL SELECT id_b, id_a, similarity FROM k WHERE similarity > 0) GROUP BY 1, 2"


@register("knn_graph", _KNN, rounded=["weight"])
def _(spark, d):
    return G.knn_graph(A.vectors(spark, d), 10)


@register("mutual_nearest", f"""WITH v AS ({A.VECS}), a AS (SELECT * FROM v WHERE label < 5), b AS (SELECT * FROM v WHERE label >= 5), p AS (SELECT a.sample_id AS id_a, b.sample_id AS id_b, list_cosine_similarity(a.vec, b.vec) AS similarity FROM a, b)
 SELECT id_a, id_b, similarity FROM p QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY round(similarity, 12) DESC, id_b) <= 5 AND row_number() OVER (PARTITION BY id_b ORDER BY round(similarity, 12) DESC, id_a) <= 5""", rounded=["similarity"])
def _(spark, d):
    v = A.vectors(spark, d)
    return V.mutual_nearest(v.where("label < 5"), v.where("label >= 5"), 5)


@register("nearest_vector_distance", f"WITH v AS ({A.VECS}) SELECT a.sample_id AS id, min(list_distance(a.vec, b.vec)) AS d FROM v AS a JOIN v AS b ON a.sample_id <> b.sample_id GROUP BY 1", rounded=["d"])
def _(spark, d):
    return V.nearest_vector_distance(A.vectors(spark, d))


@register("silhouette", f"""WITH v AS ({A.VECS}), t AS (SELECT a.sample_id AS id, a.label, b.label AS other, sum(list_distance(a.vec, b.vec)) AS total, count(*) AS n FROM v AS a JOIN v AS b ON a.sample_id <> b.sample_id GROUP BY 1, 2, 3),
 s AS (SELECT id, label, max(total / n) FILTER (WHERE other = label) AS a, min(total / n) FILTER (WHERE other <> label) AS b FROM t GROUP BY 1, 2) SELECT id, CAST(label AS VARCHAR) AS label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM s""", rounded=["silhouette"])
def _(spark, d):
    return V.silhouette(A.vectors(spark, d))


@register("silhouette_squared", f"""WITH v AS ({A.VECS}), t AS (SELECT a.sample_id AS id, a.label, b.label AS other, sum(pow(list_distance(a.vec, b.vec), 2)) AS total, count(*) AS n FROM v AS a JOIN v AS b ON a.sample_id <> b.sample_id GROUP BY 1, 2, 3),
 s AS (SELECT id, label, max(total / n) FILTER (WHERE other = label) AS a, min(total / n) FILTER (WHERE other <> label) AS b FROM t GROUP BY 1, 2) SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s""", rounded=["silhouette"])
def _(spark, d):
    return spark.createDataFrame([(V.silhouette_squared(A.vectors(spark, d)),)], "silhouette double")


# --- distance tables ---------------------------------------------------------------------

_REPS = "('1996-01', '1997-06', '1999-03')"


@register("nearest_reference_distance", f"SELECT id_a AS id, min(d) AS d FROM ({A.DIST}) WHERE id_a <> id_b GROUP BY 1", rounded=["d"])
def _(spark, d):
    return C.nearest_reference_distance(A.distances(spark, d))


@register("divergent_count", f"SELECT count(*) FILTER (WHERE d > 0.45) AS n_divergent, count(*) AS n FROM (SELECT id_a, min(d) AS d FROM ({A.DIST}) WHERE id_b IN {_REPS} GROUP BY 1)")
def _(spark, d):
    reps = A.distances(spark, d).where(f"id_a = id_b and id_a in {_REPS}").select(F.col("id_a").alias("id"))
    return C.divergent_count(A.distances(spark, d), reps, 0.45)


def _year_labels(spark, d):
    return A.distances(spark, d).where("id_a = id_b").select(F.col("id_a").alias("id"), F.substring("id_a", 1, 4).cast("int").alias("cluster"))


@register("within_group_max", f"SELECT CAST(substr(id_a, 1, 4) AS INTEGER) AS cluster, count(DISTINCT id_a) AS size, max(d) AS max_distance FROM ({A.DIST}) WHERE substr(id_a, 1, 4) = substr(id_b, 1, 4) GROUP BY 1", rounded=["max_distance"])
def _(spark, d):
    return C.within_group_max(A.distances(spark, d), _year_labels(spark, d))


@register("distance_kernel", f"SELECT id_a, id_b, exp(-2 * d / stddev_samp(d) OVER (PARTITION BY id_b)) AS similarity FROM ({A.DIST})", rounded=["similarity"])
def _(spark, d):
    return C.distance_kernel(A.distances(spark, d))


_CENT = f"""v AS ({A.VECS}), u AS (SELECT sample_id, label, unnest(vec) AS x, unnest(range(64)) AS i FROM v), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2)"""


@register("nearest_to_centroid", f"WITH {_CENT}, q AS (SELECT sample_id, u.label, sqrt(sum((x - m) * (x - m))) AS d FROM u JOIN m ON u.label = m.label AND u.i = m.i GROUP BY 1, 2) SELECT label AS cluster, sample_id AS id, d FROM q QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(d, 9), sample_id) = 1", rounded=["d"])
def _(spark, d):
    v = A.vectors(spark, d)
    labels = v.select(F.col("sample_id").alias("id"), F.col("label").alias("cluster"))
    return C.nearest_to_centroid(v, labels, C.cluster_means(v, labels))


@register("single_link_clusters", f"""WITH RECURSIVE e AS (SELECT id_a, id_b FROM ({A.DIST}) WHERE d <= 0.35), reach AS (SELECT id_a AS id, id_b AS c FROM e UNION SELECT r.id, e.id_b FROM reach AS r JOIN e ON r.c = e.id_a)
 SELECT id, min(c) AS component FROM reach GROUP BY 1""")
def _(spark, d):
    return C.single_link_clusters(A.distances(spark, d), 0.35)


@register("k_medoids_step", f"""WITH t AS ({A.DIST}), k AS (SELECT id FROM (SELECT DISTINCT id_a AS id FROM t) ORDER BY md5('42|' || id) LIMIT 5), a AS (SELECT id_a AS id, id_b AS medoid FROM t WHERE id_b IN (SELECT id FROM k) QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d, id_b) = 1),
 m AS (SELECT x.medoid, t.id_a, avg(d) AS m FROM t JOIN a AS x ON x.id = t.id_a JOIN a AS y ON y.id = t.id_b AND x.medoid = y.medoid GROUP BY 1, 2) SELECT medoid, id_a AS id FROM m QUALIFY row_number() OVER (PARTITION BY medoid ORDER BY round(m, 12), id_a) = 1""")
def _(spark, d):
    from cohortia.operators.ordered import seeded_key

    dist = A.distances(spark, d)
    start = dist.select(F.col("id_a").alias("id")).distinct().orderBy(seeded_key(42, "id")).limit(5)
    return C.medoid_update(dist, C.medoid_assign(dist, start))


@register("k_medoids")
def _(spark, d):
    return C.k_medoids(A.distances(spark, d), 5)


def _dist_vectors(dist):
    """Rows of the distance matrix as vectors, the way a clustering of a matrix reads it."""
    a = dist.select(F.col("id_a").alias("sample_id"), F.col("id_b").alias("feature_id"), F.col("d").alias("value"))
    return R.matrix_to_vectors(a, R.feature_index(a))


@register("kmeans")
def _(spark, d):
    return C.kmeans(A.vectors(spark, d), 8)[0]


@register("kmeans_elbow")
def _(spark, d):
    return C.kmeans_elbow(A.vectors(spark, d))


@register("representatives")
def _(spark, d):
    dist = cut_lineage(A.distances(spark, d))
    v = cut_lineage(_dist_vectors(dist))
    labels, centres, _ = C.kmeans(v, 5)
    return C.representatives(v, labels, centres, dist)


@register("cluster_count_sweep")
def _(spark, d):
    dist = cut_lineage(A.distances(spark, d))
    return C.cluster_count_sweep(_dist_vectors(dist), dist, cutoff=0.45)


@register("hierarchical_clusters")
def _(spark, d):
    return C.hierarchical_clusters(A.vectors(spark, d), 6)


@register("spectral_clusters")
def _(spark, d):
    k = C.distance_kernel(cut_lineage(A.distances(spark, d))).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("similarity").alias("weight"))
    return C.spectral_clusters(k, 6)


# --- propagation -------------------------------------------------------------------------

_EDGE = f"SELECT id_a AS src, id_b AS dst, 1 - d AS weight FROM ({A.DIST}) WHERE id_a <> id_b AND d <= 0.45"
_VALS = "SELECT strftime(o_orderdate, '%Y-%m') AS sample_id, o_orderpriority AS feature_id, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2"


def _edges(spark, d):
    return A.distances(spark, d).where("id_a <> id_b and d <= 0.45").select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), (1 - F.col("d")).alias("weight"))


def _values(spark, d):
    return A.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("sample_id"), F.col("o_orderpriority").alias("feature_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))


_PROP = f"""WITH x AS ({_VALS}), e AS ({_EDGE} UNION ALL SELECT DISTINCT sample_id, sample_id, 1.0 FROM x), g AS (SELECT src AS n, sum(weight) AS deg FROM e GROUP BY 1),
 w AS (SELECT e.src, e.dst, weight / sqrt(a.deg * b.deg) AS w FROM e JOIN g AS a ON a.n = e.src JOIN g AS b ON b.n = e.dst)"""


@register("graph_propagate", _PROP + " SELECT dst AS sample_id, feature_id, sum(w * value) AS value FROM w JOIN x ON x.sample_id = w.src GROUP BY 1, 2", rounded=["value"])
def _(spark, d):
    return G.graph_propagate(_edges(spark, d), _values(spark, d))


@register("graph_propagate_twice", _PROP + ", y AS (SELECT dst AS sample_id, feature_id, sum(w * value) AS value FROM w JOIN x ON x.sample_id = w.src GROUP BY 1, 2) SELECT dst AS sample_id, feature_id, sum(w * value) AS value FROM w JOIN y ON y.sample_id = w.src GROUP BY 1, 2", rounded=["value"])
def _(spark, d):
    return G.graph_propagate(_edges(spark, d), _values(spark, d), 2)


# --- pathways ----------------------------------------------------------------------------

_PW = "SELECT 'F' || l_partkey AS feature_id, 'S' || l_suppkey AS pathway_id, sum(l_quantity) - 25 AS weight FROM lineitem GROUP BY 1, 2"


def _pathway_weights(spark, d):
    return A.assay(spark, d).select("feature_id", F.col("sample_id").alias("pathway_id"), (F.col("value") - 25).alias("weight"))


@register("gene_pathway_edges", f"""WITH w AS ({_PW}), g AS (SELECT feature_id FROM w GROUP BY 1 ORDER BY sum(abs(weight)) DESC, feature_id LIMIT 10), p AS (SELECT pathway_id FROM w GROUP BY 1 ORDER BY avg(abs(weight)) DESC, pathway_id LIMIT 50)
 SELECT * FROM w WHERE abs(weight) > 0.1 AND feature_id IN (SELECT feature_id FROM g) AND pathway_id IN (SELECT pathway_id FROM p)""")
def _(spark, d):
    return G.gene_pathway_edges(_pathway_weights(spark, d), 10, 50)


@register("gene_importance", f"SELECT feature_id, sum(abs(weight)) AS importance FROM ({_PW}) GROUP BY 1")
def _(spark, d):
    return P.gene_importance(_pathway_weights(spark, d))


@register("gene_importance_mean", f"SELECT feature_id, avg(abs(weight)) AS importance FROM ({_PW}) GROUP BY 1", rounded=["importance"])
def _(spark, d):
    return P.gene_importance(_pathway_weights(spark, d), "mean")


@register("membership_matrix", f"SELECT DISTINCT feature_id, pathway_id FROM ({A.MEMBERS}) WHERE feature_id IN (SELECT feature_id FROM ({A.ASSAY}))")
def _(spark, d):
    return P.membership_matrix(A.assay(spark, d), A.members(spark, d))


@register("pathway_coverage", f"""WITH n AS (SELECT f.feature_id, count(pathway_id) AS n FROM ({A.FEATURES}) AS f LEFT JOIN (SELECT DISTINCT feature_id, pathway_id FROM ({A.MEMBERS}) AS m UNION SELECT feature_id, process_id FROM ({A.MEMBERS}) AS m JOIN ({A.PROCESS}) AS p ON m.pathway_id = p.pathway_id) AS m ON m.feature_id = f.feature_id GROUP BY 1)
 SELECT count(*) AS n_features, count(*) FILTER (WHERE n = 0) AS n_uncovered, avg(n) AS mean_pathways, quantile_cont(n, 0.5) AS median_pathways FROM n""", rounded=["mean_pathways", "median_pathways"])
def _(spark, d):
    m = A.members(spark, d)
    both = m.unionByName(m.join(A.process_members(spark, d), "pathway_id").select(F.col("process_id").alias("pathway_id"), "feature_id"))
    return P.pathway_coverage(A.features(spark, d), both)


_Z = f"SELECT sample_id, feature_id, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-9 THEN stddev_pop(value) OVER w ELSE 1 END AS value FROM ({A.grid_sql(A.ASSAY)}) WINDOW w AS (PARTITION BY feature_id)"
_SC = f"SELECT sample_id, pathway_id AS feature_id, avg(value) AS value FROM ({_Z}) AS z JOIN ({A.MEMBERS}) AS m ON z.feature_id = m.feature_id GROUP BY 1, 2"


def _scores(spark, d):
    a = A.assay(spark, d)
    return P.pathway_score(standardise(a), A.members(spark, d), absent=standardised_zero(a))


@register("pathway_score", _SC, rounded=["value"])
def _(spark, d):
    return _scores(spark, d)


@register("pathway_score_weighted", f"SELECT z.sample_id, brand AS feature_id, greatest(sum(w * value) / sum(abs(w)), 0.0) AS value FROM ({_Z}) AS z JOIN (SELECT feature_id, brand, length / 10.0 AS w FROM ({A.FEATURES})) AS f ON z.feature_id = f.feature_id GROUP BY 1, 2", rounded=["value"])
def _(spark, d):
    w = A.features(spark, d).select("feature_id", F.col("brand").alias("pathway_id"), (F.col("length") / 10.0).alias("weight"))
    a = A.assay(spark, d)
    return P.pathway_score(standardise(a), A.members(spark, d), w, relu=True, absent=standardised_zero(a))


@register("process_score", f"SELECT sample_id, process_id AS feature_id, avg(value) AS value FROM ({_SC}) AS s JOIN ({A.PROCESS}) AS p ON s.feature_id = p.pathway_id GROUP BY 1, 2", rounded=["value"])
def _(spark, d):
    return P.process_score(_scores(spark, d), A.process_members(spark, d))


@register("pathway_importance", f"SELECT feature_id, importance, CAST(row_number() OVER (ORDER BY round(importance, 9) DESC, feature_id) AS INTEGER) AS rank FROM (SELECT feature_id, avg(value) AS importance FROM ({_SC}) GROUP BY 1)", rounded=["importance"])
def _(spark, d):
    return P.pathway_importance(_scores(spark, d))


@register("differential_pathways", f"""WITH j AS (SELECT s.feature_id, value, label FROM ({_SC}) AS s JOIN ({A.SAMPLES}) AS g ON s.sample_id = g.sample_id), m AS (SELECT feature_id, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0,
 avg(value) FILTER (WHERE label = 1) AS mean1, avg(value) FILTER (WHERE label = 0) AS mean0, var_samp(value) FILTER (WHERE label = 1) AS v1, var_samp(value) FILTER (WHERE label = 0) AS v0 FROM j GROUP BY 1)
 SELECT feature_id, n1, n0, mean1, mean0, mean1 - mean0 AS diff, (mean1 - mean0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df, (mean1 - mean0) / sqrt((v1 + v0) / 2) AS d FROM m""", rounded=["mean1", "mean0", "diff", "t", "df", "d"], digits=5)
def _(spark, d):
    return P.differential_pathways(_scores(spark, d), A.samples(spark, d)).drop("p", "significant")


_SELECTED = f"SELECT feature_id FROM ({A.FEATURES}) WHERE length > 40"


@register("pathway_enrichment", f"SELECT pathway_id, count(*) AS size, count(s.feature_id) AS overlap, (SELECT count(*) FROM ({_SELECTED})) AS selected, (SELECT count(*) FROM part) AS universe FROM ({A.MEMBERS}) AS m LEFT JOIN ({_SELECTED}) AS s ON s.feature_id = m.feature_id GROUP BY 1")
def _(spark, d):
    f = A.features(spark, d)
    return P.pathway_enrichment(f.where("length > 40"), A.members(spark, d), f).drop("p")


@register("pathway_enrichment_pvalues", f"SELECT *, {tails_sql.hypergeometric_upper('overlap', 'selected', 'size', 'universe')} AS p FROM (SELECT pathway_id, count(*) AS size, count(s.feature_id) AS overlap, (SELECT count(*) FROM ({_SELECTED})) AS selected, (SELECT count(*) FROM part) AS universe FROM ({A.MEMBERS}) AS m LEFT JOIN ({_SELECTED}) AS s ON s.feature_id = m.feature_id GROUP BY 1)", rounded=["p"])
def _(spark, d):
    f = A.features(spark, d)
    return P.pathway_enrichment(f.where("length > 40"), A.members(spark, d), f)


@register("class_pathways", f"""WITH t AS (SELECT feature_id AS pathway_id, avg(value) AS activation FROM ({_SC}) WHERE sample_id IN (SELECT sample_id FROM ({A.SAMPLES}) WHERE label = 1) GROUP BY 1 ORDER BY round(activation, 9) DESC, pathway_id LIMIT 5),
 g AS (SELECT pathway_id, string_agg(feature_id, ',' ORDER BY feature_id) AS genes FROM (SELECT DISTINCT pathway_id, feature_id FROM ({A.MEMBERS}) QUALIFY row_number() OVER (PARTITION BY pathway_id ORDER BY feature_id) <= 5) GROUP BY 1),
 q AS (SELECT pathway_id, string_agg(process_id, ',' ORDER BY process_id) AS processes FROM ({A.PROCESS}) GROUP BY 1) SELECT t.pathway_id, activation, genes, coalesce(processes, '') AS processes FROM t LEFT JOIN g ON g.pathway_id = t.pathway_id LEFT JOIN q ON q.pathway_id = t.pathway_id""", rounded=["activation"])
def _(spark, d):
    return P.class_pathways(_scores(spark, d), A.samples(spark, d), A.members(spark, d), A.process_members(spark, d), 1)
