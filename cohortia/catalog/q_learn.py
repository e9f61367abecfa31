"""Learners, selection, survival models and studies."""

from pyspark.sql import functions as F

from cohortia.catalog.registry import register
from cohortia.operators import encode as E
from cohortia.operators import graph as G
from cohortia.operators import hazard as H
from cohortia.operators import learn as L
from cohortia.operators import normalise as N
from cohortia.operators import select as S
from cohortia.operators import splits as P
from cohortia.plans import studies
from cohortia.session import cut_lineage
from cohortia.sources import adapters as A
from cohortia.sources.bundle import CohortBundle


def _bundle(spark, d):
    a = A.brand_assay(spark, d).groupBy("sample_id", "feature_id").agg(F.sum("value").alias("value")).withColumn("modality", F.lit("rna"))
    a = cut_lineage(a)
    f = a.select("feature_id").distinct().withColumn("penalty_factor", F.lit(1))
    return CohortBundle(a, A.samples(spark, d), f, {"source": "demo"})


def _vecs(spark, d):
    """Supplier vectors over brands, standardised, with the class."""
    vecs, ids = studies.bundle_vectors(_bundle(spark, d), ["label"])
    vecs = cut_lineage(vecs)
    return cut_lineage(L.scale_vectors(vecs, *L.vector_moments(vecs))), ids


def _fit(spark, d, learner):
    vecs, _ = _vecs(spark, d)
    parts = P.train_test_split(vecs, {"train": 0.75, "test": 0.25}, "label")
    return L.fit(learner, parts.where("part = 'train'")).transform(parts.where("part = 'test'"))


for _name, _learner in {
    "logreg": L.logreg(0.1), "logreg_elastic_net": L.logreg(1.0, 0.5), "linear_svm": L.linear_svm(0.1), "kernel_svm": L.kernel_svm(1.0, 0.05, 100),
    "random_forest": L.random_forest(20, 4), "gradient_boosting": L.gradient_boosting(8, 3),
}.items():
    register(_name)(lambda spark, d, learner=_learner: _fit(spark, d, learner))


@register("multinomial")
def _(spark, d):
    vecs = A.vectors(spark, d)
    parts = P.train_test_split(vecs, {"train": 0.75, "test": 0.25}, "label")
    return L.fit(L.multinomial(1.0), parts.where("part = 'train'")).transform(parts.where("part = 'test'")).select("sample_id", "label", "pred")


@register("grid_search")
def _(spark, d):
    vecs, _ = _vecs(spark, d)
    folds = P.fold_assign(vecs, 2, ["label"]).drop("repeat")
    return L.grid_search(folds, L.logreg, {"C": [0.01, 1.0]})[0]


@register("model_weights")
def _(spark, d):
    vecs, ids = _vecs(spark, d)
    return L.model_weights(L.fit(L.logreg(1.0, 1.0), vecs), ids, vecs)


@register("select_from_model")
def _(spark, d):
    vecs, ids = _vecs(spark, d)
    return S.select_from_model(L.model_weights(L.fit(L.logreg(0.1), vecs), ids, vecs), "mean", 10)


_J = f"SELECT a.feature_id, value, label FROM (SELECT sample_id, feature_id, sum(value) AS value FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2) AS a JOIN ({A.SAMPLES}) AS s ON a.sample_id = s.sample_id"


@register("select_k_best", f"""WITH j AS ({_J}), c AS (SELECT feature_id, label, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM j GROUP BY 1, 2), s AS (SELECT feature_id, sum(c) AS n, count(*) AS k, sum(c * m) / sum(c) AS gm, sum(c * v) AS wi, sum(c * m * m) AS q FROM c GROUP BY 1)
 SELECT feature_id, f FROM (SELECT feature_id, (q - n * gm * gm) / (k - 1) / (wi / (n - k)) AS f FROM s) ORDER BY round(f, 9) DESC, feature_id LIMIT 10""", rounded=["f"], digits=5)
def _(spark, d):
    return S.select_k_best(_bundle(spark, d).assay, A.samples(spark, d), 10)


@register("rfe")
def _(spark, d):
    vecs, ids = _vecs(spark, d)
    return S.rfe(vecs, ids, 10, 0.4, 12, L.linear_svm(0.1), ids[:2])


@register("select_limma")
def _(spark, d):
    b = _bundle(spark, d)
    return S.select_limma(N.log_cpm(b.assay, N.tmm_factors(b.assay)), b.samples, 10)


@register("select_edger")
def _(spark, d):
    b = _bundle(spark, d)
    return S.select_edger(b.assay, b.samples, N.tmm_factors(b.assay), 10)


@register("pca")
def _(spark, d):
    v = A.vectors(spark, d)
    p = L.pca(v, None, 0.9)
    return p.scores.select("sample_id", F.posexplode("vec").alias("component", "value"))


def _modalities(spark, d):
    a = A.brand_assay(spark, d)
    return {m: a.where(F.col("modality") == m) for m in ("A", "N", "R")}


@register("joint_latent")
def _(spark, d):
    latent, _, _ = L.joint_latent(_modalities(spark, d), 4)
    return latent.scores.select("sample_id", F.posexplode("vec").alias("component", "value"))


_LOAD = "SELECT l_linenumber AS component, 'F' || l_partkey AS feature_id, max(l_discount) - max(l_tax) AS loading FROM lineitem GROUP BY 1, 2"
_LAT = "SELECT 'S' || l_suppkey AS sample_id, l_linenumber AS component, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2"


def _loadings(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("component"), F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("feature_id")).agg((F.max("l_discount") - F.max("l_tax")).alias("loading"))


@register("decoder_importance", f"SELECT feature_id, sum(abs(loading)) AS importance FROM ({_LOAD}) GROUP BY 1", rounded=["importance"])
def _(spark, d):
    return L.decoder_importance(_loadings(spark, d))


@register("latent_sensitivity", f"SELECT s.sample_id, f.feature_id, sqrt(coalesce(sum(s.value * s.value * l.loading * l.loading), 0)) AS value FROM (SELECT DISTINCT feature_id FROM ({_LOAD})) AS f JOIN ({_LAT}) AS s ON true LEFT JOIN ({_LOAD}) AS l ON l.feature_id = f.feature_id AND l.component = s.component GROUP BY 1, 2", rounded=["value"])
def _(spark, d):
    s = A.table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample_id"), F.col("l_linenumber").alias("component")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return L.latent_sensitivity(s, _loadings(spark, d))


@register("graph_features_classify")
def _(spark, d):
    v = A.vectors(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))
    edges = cut_lineage(G.knn_graph(v, 10))
    train = P.train_test_split(v, {"train": 0.75, "test": 0.25}, "label").where("part = 'train'")
    return G.graph_features_classify(edges, v, 2, L.logreg(1.0), train)[0]


# --- survival learners -------------------------------------------------------------------


def _patients(spark, d):
    """Customers as patients: order aggregates as features; time to the last order, event when its status is F."""
    o, li = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    last = o.agg(F.max("o_orderdate")).scalar()
    per_order = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("lines"))
    j = o.join(per_order, "o_orderkey")
    x = j.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("group_id"),
                 F.array("q", "disc", "tax", "lines", F.col("o_totalprice")).alias("vec"), F.datediff(last, "o_orderdate").cast("double").alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"))
    x = cut_lineage(x)
    return cut_lineage(L.scale_vectors(x, *L.vector_moments(x)))


_FEATS = ["quantity", "discount", "tax", "lines", "price"]


@register("cox_elastic_net")
def _(spark, d):
    p = H.cox_elastic_net(_patients(spark, d), [0, 1, 1, 1, 1], (0.5, 0.9), 10, 0.05)
    return p.table(spark, _FEATS)


@register("cox_ridge")
def _(spark, d):
    return H.cox_ridge(_patients(spark, d), 0.01, "efron").table(spark, _FEATS)


@register("boosted_cox")
def _(spark, d):
    return H.boosted_cox(_patients(spark, d), 20, 0.1, 3)


@register("survival_forest")
def _(spark, d):
    return H.survival_forest(_patients(spark, d), 10, 4)


@register("survival_ranker")
def _(spark, d):
    x = _patients(spark, d)
    return H.risk_scores(x, H.survival_ranker(x, 1.0, 1.0)).select("sample_id", "time", "event", "score")


@register("survival_regression")
def _(spark, d):
    x = _patients(spark, d)
    return H.risk_scores(x, H.survival_ranker(x, 1.0, 0.0)).select("sample_id", "time", "event", "score")


# --- studies -----------------------------------------------------------------------------


@register("nested_cv")
def _(spark, d):
    b = _bundle(spark, d)
    vecs, ids = studies.bundle_vectors(b, ["label"])
    outer = studies.outer_splits(b.samples, 2, 1, True)
    return L.nested_cv(cut_lineage(vecs), ids, L.logreg, {"C": [0.1]}, cut_lineage(outer), 2, selector=S.k_best_selector(10)).split_scores


@register("encode_covariates", f"""WITH s AS (SELECT sample_id, balance, CASE WHEN balance < 3000 THEN 'low' WHEN balance < 4000 THEN 'mid' ELSE 'very high' END AS grp, CASE WHEN label = 1 THEN 'ii' ELSE 'NA' END AS stage FROM ({A.SAMPLES}))
 SELECT sample_id, feature_id, sum(value) AS value, 'rna' AS modality FROM ({A.BRAND_ASSAY}) GROUP BY 1, 2 UNION ALL SELECT sample_id, 'balance', balance, 'clinical' FROM s UNION ALL SELECT sample_id, 'stage', CASE WHEN stage = 'ii' THEN 3.0 ELSE 4.0 END, 'clinical' FROM s
 UNION ALL SELECT sample_id, 'grp_' || replace(g, ' ', '_'), CASE WHEN grp = g THEN 1.0 ELSE 0.0 END, 'clinical' FROM s, (SELECT unnest(['low', 'mid', 'very high']) AS g)""")
def _(spark, d):
    b = _bundle(spark, d)
    s = b.samples.withColumns({"grp": F.when(F.col("balance") < 3000, "low").when(F.col("balance") < 4000, "mid").otherwise("very high"), "stage": F.when(F.col("label") == 1, "ii").otherwise("NA")})
    out = studies.encode_covariates(CohortBundle(b.assay, s, b.features, b.meta), ["balance", "grp", "stage"], {"stage": E.TUMOR_STAGES})
    return out.assay


@register("response_study")
def _(spark, d):
    return studies.response_study(_bundle(spark, d), "logreg", {"C": [0.01, 1.0]}, 2, 1, 2, 100)["feature_ranking"]


@register("permutation_refit")
def _(spark, d):
    b = _bundle(spark, d)
    vecs, ids = studies.bundle_vectors(b, ["label"])
    vecs = cut_lineage(vecs)
    t = L.nested_cv(vecs, ids, L.logreg, {"C": [0.01, 1.0]}, cut_lineage(studies.outer_splits(b.samples, 4, 1, False)), 3)
    true = t.split_scores.where("metric = 'roc_auc'").agg(F.avg("value")).first()[0]
    summary, perms = L.refit_permutation(vecs, {s: L.logreg(**c) for s, c in t.chosen.items()}, 4, 1, true)
    return perms.withColumn("s", summary.select(F.struct("*")).scalar()).select("perm", "value", "s.true", "s.mean_permuted", "s.p")


@register("survival_study")
def _(spark, d):
    x = _patients(spark, d)
    long = x.select("sample_id", F.posexplode("vec").alias("i", "value")).select("sample_id", F.element_at(F.array(*[F.lit(f) for f in _FEATS]), F.col("i") + 1).alias("feature_id"), "value", F.lit("clinical").alias("modality"))
    b = CohortBundle(long, x.select("sample_id", "group_id", "time", "event"), long.select("feature_id").distinct())
    return studies.survival_study(b, (0.5,), 5, 2, inner_k=2, inner_repeats=1)["split_scores"]  # a penalty may well select no feature


@register("model_comparison", f"""WITH s AS (SELECT * FROM ({A.SCORES}) WHERE metric = 'roc_auc'), r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0 AS rank,
 row_number() OVER (PARTITION BY dataset ORDER BY value DESC, model) AS k FROM s) SELECT model, avg(rank) AS mean_rank, count(*) FILTER (WHERE k = 1) AS wins, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM r GROUP BY 1""", rounded=["mean_rank", "mean", "std"])
def _(spark, d):
    return studies.comparison_summary(A.scores(spark, d))


@register("representation_report")
def _(spark, d):
    return studies.representation_report(_modalities(spark, d), A.samples(spark, d), 4, 2, A.selected_sets(spark, d))
