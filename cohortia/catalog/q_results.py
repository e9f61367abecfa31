"""Result tables, rankings, metrics and splits."""

from pyspark.sql import functions as F

from cohortia.catalog import tails_sql
from cohortia.catalog.registry import register
from cohortia.operators import metrics as M
from cohortia.operators import results as R
from cohortia.operators import splits as S
from cohortia.sources import adapters as A

_SCORE_SUM = f"SELECT model, dataset, stage, metric, count(*) AS n_splits, avg(value) AS mean, stddev_pop(value) AS std FROM ({A.SPLIT_SCORES}) GROUP BY 1, 2, 3, 4"


@register("score_summary", _SCORE_SUM, rounded=["mean", "std"])
def _(spark, d):
    return R.score_summary(A.split_scores(spark, d))


@register("cv_report", f"SELECT model, metric, count(*) AS n_splits, avg(value) AS mean, stddev_pop(value) AS std FROM ({A.SPLIT_SCORES}) GROUP BY 1, 2", rounded=["mean", "std"])
def _(spark, d):
    return R.cv_report(A.split_scores(spark, d))


@register("param_score_profile", f"""WITH l AS (SELECT split, metric, mean_score, std_score, 'c' AS param, c AS value FROM ({A.CV_RESULTS}) UNION ALL SELECT split, metric, mean_score, std_score, 'gamma', gamma FROM ({A.CV_RESULTS})),
 b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY split, param, value, metric ORDER BY mean_score DESC, std_score) = 1)
 SELECT param, value, metric, count(*) AS n_splits, avg(mean_score) AS mean_score, stddev_pop(mean_score) AS std_score, avg(std_score) AS mean_std FROM b GROUP BY 1, 2, 3""", rounded=["mean_score", "std_score", "mean_std"])
def _(spark, d):
    return R.param_score_profile(A.cv_results(spark, d))


_FREQ = f"WITH w AS ({A.SPLIT_WEIGHTS}) SELECT w.model, feature_id, count(DISTINCT split) AS n, count(DISTINCT split) * 100.0 / any_value(s) AS percent FROM w JOIN (SELECT model, count(DISTINCT split) AS s FROM w GROUP BY 1) AS t ON w.model = t.model GROUP BY 1, 2"


@register("selection_frequency", _FREQ, rounded=["percent"])
def _(spark, d):
    return R.selection_frequency(A.split_weights(spark, d))


@register("mean_importance", f"SELECT model, feature_id, avg(weight) AS importance, count(*) AS n FROM ({A.SPLIT_WEIGHTS}) GROUP BY 1, 2", rounded=["importance"])
def _(spark, d):
    return R.mean_importance(A.split_weights(spark, d))


@register("model_performance_table", f"SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM ({A.SCORES}) GROUP BY 1, 2", rounded=["mean", "std"])
def _(spark, d):
    return R.model_performance_table(A.scores(spark, d))


_RANKS = f"""SELECT model, dataset, value, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0 AS rank FROM ({A.SCORES}) WHERE metric = 'roc_auc'"""


@register("rank_models", _RANKS, rounded=["value", "rank"])
def _(spark, d):
    return R.rank_models(A.scores(spark, d), "roc_auc")


@register("mean_rank", f"SELECT model, avg(rank) AS mean_rank, count(*) AS n_datasets FROM ({_RANKS}) GROUP BY 1", rounded=["mean_rank"])
def _(spark, d):
    return R.mean_rank(R.rank_models(A.scores(spark, d), "roc_auc"))


@register("rank_distribution", f"SELECT model, place, count(*) FILTER (WHERE rank = place) AS n FROM ({_RANKS}), (SELECT unnest([1, 2, 3, 4]) AS place) GROUP BY 1, 2")
def _(spark, d):
    return R.rank_distribution(R.rank_models(A.scores(spark, d), "roc_auc"))


@register("best_model_per_dataset", f"SELECT dataset, model, value FROM ({A.SCORES}) WHERE metric = 'roc_auc' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY value DESC, model) = 1", rounded=["value"])
def _(spark, d):
    return R.best_model_per_dataset(A.scores(spark, d))


_PT = f"""WITH s AS (SELECT * FROM ({A.SCORES}) WHERE metric = 'roc_auc') SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, avg(a.value - b.value) AS mean_diff,
 avg(a.value - b.value) / (stddev_samp(a.value - b.value) / sqrt(count(*))) AS t FROM s AS a JOIN s AS b ON a.dataset = b.dataset AND a.model < b.model GROUP BY 1, 2 HAVING count(*) >= 2"""


@register("paired_t", _PT, rounded=["mean_diff", "t"])
def _(spark, d):
    return R.paired_t(A.scores(spark, d), "roc_auc").drop("p")


@register("paired_t_pvalues", f"SELECT *, {tails_sql.t_two_sided('t', '(n - 1)')} AS p FROM ({_PT})", rounded=["mean_diff", "t", "p"])
def _(spark, d):
    return R.paired_t(A.scores(spark, d), "roc_auc")


_CM = f"WITH p AS ({A.PREDS}) SELECT l.label, q.pred, count(p.label) AS n FROM (SELECT label FROM p UNION SELECT pred FROM p) AS l, (SELECT label AS pred FROM p UNION SELECT pred FROM p) AS q LEFT JOIN p ON p.label = l.label AND p.pred = q.pred GROUP BY 1, 2"


@register("confusion_matrix", _CM)
def _(spark, d):
    return R.confusion_matrix(A.predictions(spark, d))


@register("classification_report", f"""WITH p AS ({A.PREDS}), k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE pred = c) AS predicted, (SELECT count(*) FROM p WHERE label = c AND pred = c) AS tp
 FROM (SELECT label AS c FROM p UNION SELECT pred FROM p)), m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM k),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
 SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM f
 UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""", rounded=["precision", "recall", "f1"])
def _(spark, d):
    return R.classification_report(A.predictions(spark, d))


_RF = f"""SELECT model, split, feature_id, weight, rank() OVER (PARTITION BY model, split ORDER BY abs(weight) DESC) AS rank, count(*) OVER (PARTITION BY model, split) AS n_present FROM ({A.SPLIT_WEIGHTS})"""


@register("rank_features", _RF)
def _(spark, d):
    return R.rank_features(A.split_weights(spark, d))


_TEST = "SELECT l_returnflag AS model, l_linenumber AS split, sum(CAST(l_quantity AS BIGINT)) / count(*) / 50.0 AS score FROM lineitem GROUP BY 1, 2"


@register("feature_ranking", f"""WITH r AS ({_RF}), t AS ({_TEST}), f AS (SELECT DISTINCT model, feature_id FROM r), s AS (SELECT model, split, max(n_present) AS np FROM r GROUP BY 1, 2),
 g AS (SELECT f.model, f.feature_id, coalesce(r.rank, np + 1) AS rk, coalesce(r.weight, 0) AS w, CASE WHEN r.feature_id IS NULL THEN 0.5 ELSE score END AS sc, r.feature_id IS NOT NULL AS here
  FROM f JOIN s ON s.model = f.model LEFT JOIN r ON r.model = f.model AND r.feature_id = f.feature_id AND r.split = s.split LEFT JOIN t ON t.model = s.model AND t.split = s.split)
 SELECT model, feature_id, count(*) FILTER (WHERE here) AS frequency, avg(rk) AS mean_rank, avg(w) AS mean_weight, avg(sc) AS mean_test_score FROM g GROUP BY 1, 2""", rounded=["mean_rank", "mean_weight", "mean_test_score"])
def _(spark, d):
    t = A.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("split")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count(F.lit(1)) / 50.0).alias("value"))
    return R.feature_ranking(A.split_weights(spark, d), t)


_NW = f"SELECT sample_id, feature_id, value / (sum(value) OVER (PARTITION BY sample_id) + 1e-10) AS value, modality FROM ({A.ASSAY})"


@register("normalise_within_sample", _NW, rounded=["value"], digits=9)
def _(spark, d):
    return R.normalise_within_sample(A.assay(spark, d))


@register("sample_top_quartile", f"SELECT a.*, value >= quantile_cont(value, 0.75) OVER (PARTITION BY sample_id) AS top FROM ({A.ASSAY}) AS a")
def _(spark, d):
    return R.sample_top_quartile(A.assay(spark, d))


_GI = "SELECT 'F' || l_partkey AS feature_id, CAST(count(*) AS DOUBLE) AS importance FROM lineitem GROUP BY 1"


def _global(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("feature_id")).agg(F.count(F.lit(1)).cast("double").alias("importance"))


# Quantities are whole numbers, so the quartile test on them equals the one on normalised values.
_FLAG = f"SELECT a.*, value >= quantile_cont(value, 0.75) OVER (PARTITION BY sample_id) AS top FROM ({A.ASSAY}) AS a"


@register("frequency_select", f"""SELECT t.feature_id, share, share >= 0.1 AS selected, importance * share AS importance FROM (SELECT feature_id, count(*) FILTER (WHERE top) / (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS share FROM ({_FLAG}) GROUP BY 1) AS t
 JOIN ({_GI}) AS g ON t.feature_id = g.feature_id""", rounded=["share", "importance"])
def _(spark, d):
    return R.frequency_select(A.assay(spark, d), _global(spark, d), 0.1)


@register("stratified_frequency_select", f"""WITH s AS (SELECT sample_id, label AS stratum FROM ({A.SAMPLES}) WHERE sample_id IN (SELECT sample_id FROM ({A.ASSAY}))), n AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5)
 SELECT p.*, share * g.importance AS importance FROM (SELECT s.stratum, feature_id, any_value(n) AS n, count(*) FILTER (WHERE top) / any_value(n) AS share, count(*) FILTER (WHERE top) / any_value(n) >= 0.2 AS selected FROM ({_FLAG}) AS f JOIN s ON f.sample_id = s.sample_id JOIN n ON n.stratum = s.stratum GROUP BY 1, 2) AS p
 JOIN ({_GI}) AS g ON p.feature_id = g.feature_id""", rounded=["share", "importance"])
def _(spark, d):
    return R.stratified_frequency_select(A.assay(spark, d), A.samples(spark, d), "label", 0.2, global_importance=_global(spark, d))


@register("cumulative_variance", """SELECT component, variance, sum(variance) OVER (ORDER BY component) / sum(variance) OVER () AS cumulative, sum(variance) OVER (ORDER BY component) / sum(variance) OVER () >= 0.9 AS reached
 FROM (SELECT p_size AS component, sum(p_retailprice) AS variance FROM part GROUP BY 1)""", rounded=["variance", "cumulative"])
def _(spark, d):
    c = A.table(spark, d, "part").groupBy(F.col("p_size").alias("component")).agg(F.sum("p_retailprice").alias("variance"))
    return R.cumulative_variance(c)


@register("sorted_heatmap", f"""SELECT s.sample_id, label, "Brand#1", "Brand#2", "Brand#3" FROM ({A.SAMPLES}) AS s JOIN (SELECT sample_id, sum(CASE WHEN feature_id = 'Brand#1' THEN value END) AS "Brand#1", sum(CASE WHEN feature_id = 'Brand#2' THEN value END) AS "Brand#2",
 sum(CASE WHEN feature_id = 'Brand#3' THEN value END) AS "Brand#3" FROM ({A.BRAND_ASSAY}) WHERE feature_id IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1) AS w ON s.sample_id = w.sample_id ORDER BY label, "Brand#1", "Brand#2", "Brand#3", s.sample_id""")
def _(spark, d):
    return R.sorted_heatmap(A.brand_assay(spark, d), A.samples(spark, d), ["Brand#1", "Brand#2", "Brand#3"])


_HIST = """WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM v),
 k AS (SELECT *, {bins} AS k FROM s), w AS (SELECT *, (hi - lo) / k AS w FROM k), c AS (SELECT CAST(least(floor((v - lo) / w), k - 1) AS INTEGER) AS bin, count(*) AS n FROM v, w GROUP BY 1)
 SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * w AS "left", lo + (b.bin + 1) * w AS "right", coalesce(c.n, 0) AS n FROM w, LATERAL (SELECT unnest(range(CAST(k AS BIGINT))) AS bin) AS b LEFT JOIN c ON c.bin = b.bin"""


@register("histogram", _HIST.format(bins="100"), rounded=["left", "right"])
def _(spark, d):
    return R.histogram(A.table(spark, d, "documents"), "n_chars", 100)


@register("histogram_fd", _HIST.format(bins="greatest(1, CAST(round((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))) AS INTEGER))"), rounded=["left", "right"])
def _(spark, d):
    return R.histogram(A.table(spark, d, "documents"), "n_chars", "fd")


# --- metrics -----------------------------------------------------------------------------

_TH = f"""WITH c AS (SELECT model, split, score, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE weight END) AS neg FROM ({A.PREDS}) GROUP BY 1, 2, 3),
 t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS "P", sum(neg) OVER p AS "N" FROM c WINDOW w AS (PARTITION BY model, split ORDER BY score DESC), p AS (PARTITION BY model, split))"""


@register("roc_auc", _TH + """ SELECT model, split, CASE WHEN max("P") > 0 AND max("N") > 0 THEN sum(neg * (tp - pos / 2)) / (max("P") * max("N")) END AS roc_auc FROM t GROUP BY 1, 2""", rounded=["roc_auc"])
def _(spark, d):
    return M.roc_auc(A.predictions(spark, d))


_ROC = _TH + """ SELECT model, split, score AS threshold, fp / "N" AS fpr, tp / "P" AS tpr FROM t WHERE "P" > 0 AND "N" > 0 UNION ALL SELECT DISTINCT model, split, NULL, 0.0, 0.0 FROM t WHERE "P" > 0 AND "N" > 0"""
_PR = _TH + """ SELECT model, split, score AS threshold, tp / "P" AS recall, tp / (tp + fp) AS precision FROM t WHERE "P" > 0 UNION ALL SELECT DISTINCT model, split, NULL, 0.0, 1.0 FROM t WHERE "P" > 0"""


@register("roc_curve", _ROC, rounded=["threshold", "fpr", "tpr"])
def _(spark, d):
    return M.roc_curve(A.predictions(spark, d))


@register("pr_curve", _PR, rounded=["threshold", "recall", "precision"])
def _(spark, d):
    return M.pr_curve(A.predictions(spark, d))


@register("average_precision", f"SELECT model, split, sum((recall - prev) * precision) AS average_precision FROM (SELECT *, lag(recall) OVER (PARTITION BY model, split ORDER BY threshold DESC NULLS FIRST) AS prev FROM ({_PR})) WHERE threshold IS NOT NULL GROUP BY 1, 2", rounded=["average_precision"])
def _(spark, d):
    return M.average_precision(A.predictions(spark, d))


@register("pr_auc", f"SELECT model, split, sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM (SELECT *, lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM ({_PR}) WINDOW w AS (PARTITION BY model, split ORDER BY threshold DESC NULLS FIRST)) WHERE threshold IS NOT NULL GROUP BY 1, 2", rounded=["pr_auc"])
def _(spark, d):
    return M.pr_auc(A.predictions(spark, d))


@register("balanced_accuracy", f"SELECT model, split, avg(r) AS balanced_accuracy FROM (SELECT model, split, label, sum(CASE WHEN pred = label THEN weight ELSE 0 END) / sum(weight) AS r FROM ({A.PREDS}) GROUP BY 1, 2, 3) GROUP BY 1, 2", rounded=["balanced_accuracy"])
def _(spark, d):
    return M.balanced_accuracy(A.predictions(spark, d))


@register("accuracy", f"SELECT model, split, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({A.PREDS}) GROUP BY 1, 2", rounded=["accuracy"])
def _(spark, d):
    return M.accuracy(A.predictions(spark, d))


@register("ordinal_accuracy", "SELECT model, split, avg(abs(label - pred)) AS mean_abs_diff, avg(CASE WHEN abs(label - pred) <= 1 THEN 1.0 ELSE 0.0 END) AS within_one FROM (SELECT l_returnflag AS model, l_linenumber AS split, CAST(floor(l_quantity / 10) AS INTEGER) AS label, CAST(floor(l_discount * 50) AS INTEGER) AS pred FROM lineitem) GROUP BY 1, 2", rounded=["mean_abs_diff", "within_one"])
def _(spark, d):
    p = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("split"), F.floor(F.col("l_quantity") / 10).cast("int").alias("label"), F.floor(F.col("l_discount") * 50).cast("int").alias("pred"))
    return M.ordinal_accuracy(p)


_GRID = """SELECT g.model, g.split, CAST(k AS INTEGER) AS point, k / 99.0 AS x, CASE WHEN a IS NULL THEN b.y WHEN b IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (k / 99.0 - a.x) / (b.x - a.x) END AS y FROM (
 SELECT q.model, q.split, k, max(struct_pack(o := o, x := x, y := y)) FILTER (WHERE ceil(round(x * 99, 9)) <= k) AS a, min(struct_pack(o := o, x := x, y := y)) FILTER (WHERE ceil(round(x * 99, 9)) > k) AS b
 FROM (SELECT model, split, {x} AS x, {y} AS y, coalesce(-threshold, CAST('-inf' AS DOUBLE)) AS o FROM ({src})) AS q, (SELECT unnest(range(100)) AS k) AS ks GROUP BY 1, 2, 3) AS g"""
_ORD = lambda: F.coalesce(-F.col("threshold"), F.lit(float("-inf")))


@register("interp_grid", _GRID.format(x="recall", y="precision", src=_PR), rounded=["x", "y"])
def _(spark, d):
    return M.interp_grid(M.pr_curve(A.predictions(spark, d)), ["model", "split"], "recall", "precision", _ORD())


@register("mean_curve_band", f"""WITH b AS (SELECT model, point, x, CASE WHEN point = 0 THEN 0.0 ELSE y END AS y FROM ({_GRID.format(x="fpr", y="tpr", src=_ROC)})), m AS (SELECT model, point, x, CASE WHEN point = 99 THEN 1.0 ELSE avg(y) END AS mean, stddev_pop(y) AS std, count(*) AS n FROM b GROUP BY 1, 2, 3)
 SELECT *, greatest(mean - std, 0.0) AS lower, least(mean + std, 1.0) AS upper FROM m""", rounded=["x", "mean", "std", "lower", "upper"])
def _(spark, d):
    g = M.interp_grid(M.roc_curve(A.predictions(spark, d)), ["model", "split"], "fpr", "tpr", _ORD())
    return M.mean_curve_band(g)


_PAIRS = f"""WITH s AS ({A.SURVIVAL}) SELECT i.cohort, i.time, count(DISTINCT i.sample_id) AS n_events, count(*) AS n_pairs FROM s AS i JOIN s AS j ON i.cohort = j.cohort AND (i.time < j.time OR (i.time = j.time AND j.event = 0)) WHERE i.event = 1 GROUP BY 1, 2"""


@register("comparable_pairs", _PAIRS)
def _(spark, d):
    return M.comparable_pairs(A.survival(spark, d)).where("n_pairs > 0").select("cohort", "time", "n_events", "n_pairs")


@register("c_index", f"""WITH s AS ({A.SURVIVAL}) SELECT i.cohort, count(*) AS comparable, count(*) FILTER (WHERE j.score < i.score) AS concordant, count(*) FILTER (WHERE j.score = i.score) AS tied,
 (count(*) FILTER (WHERE j.score < i.score) + 0.5 * count(*) FILTER (WHERE j.score = i.score)) / count(*) AS c_index
 FROM s AS i JOIN s AS j ON i.cohort = j.cohort AND (i.time < j.time OR (i.time = j.time AND j.event = 0)) WHERE i.event = 1 GROUP BY 1""", rounded=["c_index"], digits=9)
def _(spark, d):
    return M.c_index(A.survival(spark, d))


# --- splits ------------------------------------------------------------------------------

_LAB = "SELECT CAST(doc_id AS VARCHAR) AS sample_id, quality AS label FROM labels"


def _labels(spark, d):
    return A.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").alias("label"))


@register("kfold", f"SELECT sample_id, label, CAST((row_number() OVER (ORDER BY md5('42|0|' || sample_id)) - 1) % 5 AS INTEGER) AS fold FROM ({_LAB})")
def _(spark, d):
    return S.kfold(_labels(spark, d))


@register("repeated_stratified_kfold", f"SELECT sample_id, label, CAST(r AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY r, label ORDER BY md5('777|' || r || '|' || sample_id)) - 1) % 4 AS INTEGER) AS fold FROM ({_LAB}), (SELECT unnest(range(25)) AS r)")
def _(spark, d):
    return S.repeated_stratified_kfold(_labels(spark, d))


@register("fold_assign", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS stratum, CAST(r AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY r, o_orderstatus ORDER BY md5('777|' || r || '|' || o_orderkey)) - 1) % 3 AS INTEGER) AS fold FROM orders, (SELECT unnest(range(2)) AS r)")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("stratum"))
    return S.fold_assign(o, 3, ["stratum"], 2)


@register("repeated_stratified_group_kfold", f"""WITH s AS (SELECT *, source AS group_id FROM ({_LAB}) JOIN documents ON sample_id = CAST(doc_id AS VARCHAR)), g AS (SELECT group_id, label FROM (SELECT group_id, label, count(*) AS n FROM s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) = 1),
 f AS (SELECT group_id, CAST(r AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY r, label ORDER BY md5('777|' || r || '|' || group_id)) - 1) % 4 AS INTEGER) AS fold FROM g, (SELECT unnest(range(25)) AS r)) SELECT sample_id, s.label, s.group_id, repeat, fold FROM s JOIN f ON s.group_id = f.group_id""")
def _(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("group_id"))
    return S.repeated_stratified_group_kfold(_labels(spark, d).join(docs, "sample_id"))


@register("train_test_split", f"""SELECT sample_id, label, CASE WHEN k <= floor(n * 0.6 + 0.5) THEN 'train' WHEN k <= floor(n * 0.8 + 0.5) THEN 'val' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|0|' || sample_id)) AS k, count(*) OVER (PARTITION BY label) AS n FROM ({_LAB}))""")
def _(spark, d):
    return S.train_test_split(_labels(spark, d), {"train": 0.6, "val": 0.2, "test": 0.2}, "label")


_SURV = f"SELECT sample_id, event, group_id FROM ({A.SURVIVAL})"


@register("survival_stratified_shuffle", f"""SELECT sample_id, event, CAST(r AS INTEGER) AS split, CASE WHEN k <= floor(n * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY r, event ORDER BY md5('777|' || r || '|' || sample_id)) AS k, count(*) OVER (PARTITION BY r, event) AS n FROM ({_SURV}), (SELECT unnest(range(100)) AS r))""")
def _(spark, d):
    return S.survival_stratified_shuffle(A.survival(spark, d).select("sample_id", "event"))


@register("survival_sample_from_group", f"""WITH x AS (SELECT *, (CAST('0x' || substr(md5('777|draw|' || r || '|' || sample_id), 1, 12) AS BIGINT) + 1) / 281474976710657.0 AS u FROM ({_SURV}), (SELECT unnest(range(100)) AS r)),
 o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY r, group_id ORDER BY -ln(u), sample_id) = 1)
 SELECT sample_id, event, group_id, CAST(r AS INTEGER) AS split, CASE WHEN k <= floor(n * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY r, event ORDER BY md5('777|' || r || '|' || sample_id)) AS k, count(*) OVER (PARTITION BY r, event) AS n FROM o)""")
def _(spark, d):
    return S.survival_sample_from_group(A.survival(spark, d).select("sample_id", "event", "group_id"))


@register("repeated_survival_stratified_kfold", f"SELECT sample_id, event, CAST(r AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY r, event ORDER BY md5('777|' || r || '|' || sample_id)) - 1) % 4 AS INTEGER) AS fold FROM ({_SURV}), (SELECT unnest(range(5)) AS r)")
def _(spark, d):
    return S.repeated_survival_stratified_kfold(A.survival(spark, d).select("sample_id", "event"))


@register("permute_labels", f"""WITH x AS (SELECT sample_id, label, r, row_number() OVER (PARTITION BY r ORDER BY md5('777|to|' || r || '|' || sample_id)) AS a, row_number() OVER (PARTITION BY r ORDER BY md5('777|from|' || r || '|' || sample_id)) AS b FROM ({_LAB}), (SELECT unnest(range(10)) AS r))
 SELECT CAST(x.r AS INTEGER) AS perm, x.sample_id, y.label FROM x JOIN x AS y ON x.r = y.r AND x.a = y.b""")
def _(spark, d):
    return S.permute_labels(_labels(spark, d), 10)
