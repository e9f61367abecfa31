"""Right-censored outcomes: curves, tests, likelihoods and predicted survival.

Every operator first collapses rows to distinct times (a map-side combining aggregate) and then
uses running sums along time, so a single large cohort is never one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions import tails
from cohortia.operators.ordered import quantiles, running_totals
from cohortia.session import cut_lineage


def _times(samples: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """(by, time, n, d, …): rows and events per distinct time."""
    ev = F.col("event").cast("int")
    return samples.where(F.col("time").isNotNull() & F.col("event").isNotNull()).groupBy(*by, "time").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ev).alias("d"), *[F.sum(c).alias(k) for k, c in sums.items()])


def _at_risk(cells: DataFrame, by: Sequence[str], **sums: str) -> DataFrame:
    """Sums over rows with the same or a later time."""
    return running_totals(cells, list(by), "time", sums, ascending=False)


def risk_set_sums(samples: DataFrame, score: str = "score", by: Sequence[str] = ("cohort",)) -> DataFrame:
    """(by, time, d, at_risk, s0): Cox denominators, s0 = sum of exp(score) over the risk set."""
    return _at_risk(_times(samples, by, e=F.exp(score)), by, at_risk="n", s0="e").select(*by, "time", "d", "at_risk", "s0")


def kaplan_meier(samples: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    """(by, time, at_risk, d, survival) for every distinct time."""
    by = list(by)
    at = _at_risk(_times(samples, by), by, at_risk="n")
    gone = F.col("d") >= F.col("at_risk")
    steps = at.withColumns({"ls": F.when(gone, 0.0).otherwise(F.log(1 - F.col("d") / F.col("at_risk"))), "z": gone.cast("int")})
    cum = running_totals(steps, by, "time", {"cls": "ls", "cz": "z"})
    return cum.select(*by, "time", "at_risk", "d", F.when(F.col("cz") > 0, 0.0).otherwise(F.exp("cls")).alias("survival"))


def nelson_aalen(samples: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    """(by, time, hazard): cumulative hazard, the running sum of events over rows at risk."""
    by = list(by)
    at = _at_risk(_times(samples, by), by, at_risk="n").withColumn("h", F.col("d") / F.col("at_risk"))
    return running_totals(at, by, "time", {"hazard": "h"}).select(*by, "time", "hazard")


def martingale_residuals(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Null-model residual per sample: event minus cumulative hazard at its time."""
    by = list(by)
    return samples.join(nelson_aalen(samples, by), [*by, "time"]).withColumn("residual", F.col("event").cast("double") - F.col("hazard")).drop("hazard")


def breslow_baseline(samples: DataFrame, score: str = "score", by: Sequence[str] = ("cohort",)) -> DataFrame:
    """(by, time, hazard): baseline cumulative hazard given log-risk scores."""
    by = list(by)
    at = risk_set_sums(samples, score, by).withColumn("h", F.col("d") / F.col("s0"))
    return running_totals(at, by, "time", {"hazard": "h"}).select(*by, "time", "hazard")


def survival_function(preds: DataFrame, baseline: DataFrame, times: Sequence[float], score: str = "score", by: Sequence[str] = ("cohort",)) -> DataFrame:
    """(sample_id, by, time, survival) at requested times: exp(-H0(t) exp(score))."""
    by = list(by)
    steps = baseline.groupBy(*by).agg(F.array(*[
        F.struct(F.lit(float(t)).alias("time"), F.coalesce(F.max(F.when(F.col("time") <= float(t), F.col("hazard"))), F.lit(0.0)).alias("h")) for t in times]).alias("g"))
    joined = preds.join(steps, by) if by else preds.withColumn("g", steps.scalar())
    return joined.select("sample_id", *by, F.col(score).alias("__s"), F.inline("g")).select("sample_id", *by, "time", F.exp(-F.col("h") * F.exp("__s")).alias("survival"))


def risk_groups(preds: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """1 (high) when the score reaches the exact median, else 0."""
    by = list(by)
    med = quantiles(preds, by, score, {"__m": 0.5})
    joined = preds.join(med, by) if by else preds.withColumn("__m", med.select("__m").scalar())
    return joined.withColumn("risk", (F.col(score) >= F.col("__m")).cast("int")).drop("__m")


def cox_partial_loglik(samples: DataFrame, score: str = "score", by: Sequence[str] = ("cohort",)) -> DataFrame:
    """Negative log partial likelihood with tied times grouped (Breslow)."""
    by = list(by)
    ev = F.col("event").cast("int")
    cells = _times(samples, by, e=F.exp(score), es=F.col(score) * ev)
    at = _at_risk(cells, by, s0="e")
    return at.groupBy(*by).agg(F.sum("d").alias("n_events"), (-F.sum(F.col("es") - F.col("d") * F.log("s0"))).alias("loss"))


def _two_groups(samples: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    g = F.col(group).cast("int")
    rows = samples.where(g.isin(0, 1))
    cells = cut_lineage(_times(rows, by, n1=g, d1=g * F.col("event").cast("int")))  # one row per distinct time
    return _at_risk(cells, by, r="n", r1="n1").where("d > 0")


def logrank(samples: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-group log-rank: observed and expected events in group 1, chi-square and p."""
    by = list(by)
    t = _two_groups(samples, group, by)
    share = F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    agg = t.groupBy(*by).agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(v).alias("variance"))
    chi = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("variance"))
    return agg.withColumn("chi2", chi).withColumn("p", tails.chi2_pvalue("chi2", F.lit(1.0)))


def cox_two_group(samples: DataFrame, group: str, max_iter: int = 25, tol: float = 1e-10) -> DataFrame:
    """Hazard ratio and Wald p for a binary group: Newton on one coefficient.

    The risk table (one row per event time) is written once; each step is one aggregate of it.
    """
    t = cut_lineage(_two_groups(samples, group, []).select("time", "d", "d1", "r", "r1"))
    beta, info = 0.0, 0.0
    for _ in range(max_iter):
        p = F.col("r1") * math.exp(beta) / (F.col("r") - F.col("r1") + F.col("r1") * math.exp(beta))
        u, info = t.agg(F.sum(F.col("d1") - F.col("d") * p), F.sum(F.col("d") * p * (1 - p))).first()
        if not info:
            break
        step = u / info
        beta += max(-2.0, min(2.0, step))
        if abs(step) < tol:
            break
    se = 1 / math.sqrt(info) if info else float("nan")
    row = samples.sparkSession.createDataFrame([(beta, math.exp(beta), se, beta / se if info else float("nan"))], "coef double, hazard_ratio double, se double, z double")
    return row.withColumn("p", tails.normal_pvalue("z"))
