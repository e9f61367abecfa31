"""Censored outcomes."""

from pyspark.sql import functions as F

from cohortia.catalog import tails_sql
from cohortia.catalog.registry import register
from cohortia.operators import survival as S
from cohortia.sources import adapters as A

_S = f"WITH s AS (SELECT sample_id, cohort, time, event, score / 100000.0 AS score FROM ({A.SURVIVAL}))"
_C = _S + """, c AS (SELECT cohort, time, count(*) AS n, sum(event) AS d, sum(exp(score)) AS e, sum(score * event) AS es FROM s GROUP BY 1, 2),
 r AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS at_risk, sum(e) OVER w AS s0 FROM c WINDOW w AS (PARTITION BY cohort ORDER BY time DESC))"""


def _samples(spark, d):
    return A.survival(spark, d).withColumn("score", F.col("score") / 100000.0)


@register("risk_set_sums", _C + " SELECT cohort, time, CAST(d AS BIGINT) AS d, at_risk, s0 FROM r", rounded=["s0"], digits=4)
def _(spark, d):
    return S.risk_set_sums(_samples(spark, d))


@register("kaplan_meier", _C + """ SELECT cohort, time, at_risk, CAST(d AS BIGINT) AS d, CASE WHEN max(CASE WHEN d >= at_risk THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
 ELSE exp(sum(CASE WHEN d >= at_risk THEN 0.0 ELSE ln(1 - d / at_risk) END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY cohort ORDER BY time)""", rounded=["survival"])
def _(spark, d):
    return S.kaplan_meier(_samples(spark, d))


@register("nelson_aalen", _C + " SELECT cohort, time, sum(d / at_risk) OVER (PARTITION BY cohort ORDER BY time) AS hazard FROM r", rounded=["hazard"])
def _(spark, d):
    return S.nelson_aalen(_samples(spark, d))


@register("martingale_residuals", _C + ", h AS (SELECT cohort, time, sum(d / at_risk) OVER (PARTITION BY cohort ORDER BY time) AS hazard FROM r) SELECT sample_id, s.cohort, event - hazard AS residual FROM s JOIN h ON s.cohort = h.cohort AND s.time = h.time", rounded=["residual"])
def _(spark, d):
    return S.martingale_residuals(_samples(spark, d), ["cohort"]).select("sample_id", "cohort", "residual")


@register("cox_partial_loglik", _C + " SELECT cohort, CAST(sum(d) AS BIGINT) AS n_events, -sum(es - d * ln(s0)) AS loss FROM r GROUP BY 1", rounded=["loss"], digits=4)
def _(spark, d):
    return S.cox_partial_loglik(_samples(spark, d))


@register("breslow_baseline", _C + " SELECT cohort, time, sum(d / s0) OVER (PARTITION BY cohort ORDER BY time) AS hazard FROM r", rounded=["hazard"])
def _(spark, d):
    return S.breslow_baseline(_samples(spark, d))


@register("survival_function", _C + """, b AS (SELECT cohort, time, sum(d / s0) OVER (PARTITION BY cohort ORDER BY time) AS h FROM r), g AS (SELECT cohort, t, coalesce(max(h) FILTER (WHERE time <= t), 0) AS h FROM b, (SELECT unnest([100.0, 700.0, 2000.0]) AS t) GROUP BY 1, 2)
 SELECT sample_id, s.cohort, CAST(t AS DOUBLE) AS time, exp(-h * exp(score)) AS survival FROM s JOIN g ON s.cohort = g.cohort""", rounded=["survival"])
def _(spark, d):
    s = _samples(spark, d)
    return S.survival_function(s, S.breslow_baseline(s), [100, 700, 2000])


_RISK = _S + ", m AS (SELECT *, CASE WHEN score >= quantile_cont(score, 0.5) OVER () THEN 1 ELSE 0 END AS risk FROM s)"


@register("risk_groups", _RISK + " SELECT sample_id, risk FROM m")
def _(spark, d):
    return S.risk_groups(_samples(spark, d)).select("sample_id", "risk")


@register("risk_groups_by_cohort", _S + " SELECT sample_id, CASE WHEN score >= quantile_cont(score, 0.5) OVER (PARTITION BY cohort) THEN 1 ELSE 0 END AS risk FROM s")
def _(spark, d):
    return S.risk_groups(_samples(spark, d), by=["cohort"]).select("sample_id", "risk")


_LR = _RISK + """, c AS (SELECT time, count(*) AS n, sum(event) AS d, sum(risk) AS n1, sum(risk * event) AS d1 FROM m GROUP BY 1), r AS (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM c WINDOW w AS (ORDER BY time DESC)),
 a AS (SELECT sum(d1) AS observed, sum(d * r1 / r) AS expected, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS variance FROM r WHERE d > 0)
 SELECT CAST(observed AS BIGINT) AS observed, expected, variance, (observed - expected) * (observed - expected) / variance AS chi2 FROM a"""


@register("logrank", _LR, rounded=["expected", "variance", "chi2"])
def _(spark, d):
    return S.logrank(S.risk_groups(_samples(spark, d)), "risk").drop("p")


_LR_COHORT = f"""WITH m AS (SELECT cohort, time, event, CASE WHEN score >= quantile_cont(score, 0.5) OVER (PARTITION BY cohort) THEN 1 ELSE 0 END AS risk FROM (SELECT sample_id, cohort, time, event, score / 100000.0 AS score FROM ({A.SURVIVAL}))),
 c AS (SELECT cohort, time, count(*) AS n, sum(event) AS d, sum(risk) AS n1, sum(risk * event) AS d1 FROM m GROUP BY 1, 2),
 r AS (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM c WINDOW w AS (PARTITION BY cohort ORDER BY time DESC)),
 a AS (SELECT cohort, CAST(sum(d1) AS BIGINT) AS observed, sum(d * r1 / r) AS expected, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS variance FROM r WHERE d > 0 GROUP BY 1),
 x AS (SELECT *, (observed - expected) * (observed - expected) / variance AS chi2 FROM a) SELECT *, {tails_sql.chi2_one('chi2')} AS p FROM x"""


@register("logrank_pvalue", _LR_COHORT, rounded=["expected", "variance", "chi2", "p"])
def _(spark, d):
    return S.logrank(S.risk_groups(_samples(spark, d), by=["cohort"]), "risk", ["cohort"])


_COX_TWO = _RISK.replace("WITH s", "WITH RECURSIVE s") + f""", c AS (SELECT time, count(*) AS n, sum(event) AS d, sum(risk) AS n1, sum(risk * event) AS d1 FROM m GROUP BY 1),
 t AS (SELECT d, d1, r, r1 FROM (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM c WINDOW w AS (ORDER BY time DESC)) WHERE d > 0),
 newton AS (SELECT 0 AS i, CAST(0.0 AS DOUBLE) AS beta UNION ALL
  SELECT i + 1, beta + greatest(-2.0, least(2.0, step)) FROM newton, LATERAL (SELECT sum(d1 - d * p) / sum(d * p * (1 - p)) AS step FROM (SELECT *, r1 * exp(beta) / (r - r1 + r1 * exp(beta)) AS p FROM t)) AS u WHERE i < 15),
 e AS (SELECT beta, (SELECT sum(d * p * (1 - p)) FROM (SELECT *, r1 * exp(beta) / (r - r1 + r1 * exp(beta)) AS p FROM t)) AS info FROM newton WHERE i = 15),
 z AS (SELECT beta AS coef, exp(beta) AS hazard_ratio, 1 / sqrt(info) AS se, beta * sqrt(info) AS z FROM e) SELECT *, {tails_sql.normal_two_sided('z')} AS p FROM z"""


@register("cox_two_group", _COX_TWO, rounded=["coef", "hazard_ratio", "se", "z", "p"])
def _(spark, d):
    return S.cox_two_group(S.risk_groups(_samples(spark, d)), "risk")
