"""Classification and survival metrics computed from prediction tables, all splits at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.ordered import dominance_pairs, running_totals
from cohortia.session import cut_lineage

BY = ("model", "split")


def _weight(preds: DataFrame) -> Column:
    return F.col("weight") if "weight" in preds.columns else F.lit(1.0)


def _thresholds(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: cumulative weights of positives (tp) and negatives (fp) at or above it."""
    w = _weight(preds)
    cells = preds.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label") == 1, 0.0).otherwise(w)).alias("neg"))
    totals = cells.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return running_totals(cells, by, "score", {"tp": "pos", "fp": "neg"}, ascending=False).join(totals, list(by))


def roc_auc(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weighted area under the ROC curve, ties count one half; null when a class is absent."""
    th = _thresholds(preds, by)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return th.groupBy(*by).agg(F.when((F.max("P") > 0) & (F.max("N") > 0), area / (F.max("P") * F.max("N"))).alias("roc_auc"))


def roc_curve(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(fpr, tpr) per distinct threshold plus the origin, whose threshold is null."""
    th = _thresholds(preds, by).where("P > 0 and N > 0")
    pts = th.select(*by, F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))
    start = th.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(recall, precision) per distinct threshold plus the end point (0, 1), whose threshold is null."""
    th = _thresholds(preds, by).where("P > 0")
    pts = th.select(*by, F.col("score").alias("threshold"), (F.col("tp") / F.col("P")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    end = th.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(end)


def average_precision(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Sum of recall steps times precision; a step is the positives at one threshold."""
    th = _thresholds(preds, by).where("P > 0")
    return th.groupBy(*by).agg(F.sum(F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def pr_auc(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Trapezoid area under the precision-recall curve; the point before a threshold follows from its own cell."""
    th = _thresholds(preds, by).where("P > 0")
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 1e-12, tp0 / (tp0 + fp0)).otherwise(1.0)
    return th.groupBy(*by).agg(F.sum(F.col("pos") / F.col("P") * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2).alias("pr_auc"))


def balanced_accuracy(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    w = _weight(preds)
    per = preds.groupBy(*by, "label").agg((F.sum(F.when(F.col("pred") == F.col("label"), w).otherwise(0.0)) / F.sum(w)).alias("r"))
    return per.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))


def accuracy(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def ordinal_accuracy(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean absolute stage difference and share of predictions within one stage."""
    gap = F.abs(F.col("label") - F.col("pred"))
    return preds.groupBy(*by).agg(F.avg(gap.cast("double")).alias("mean_abs_diff"), F.avg((gap <= 1).cast("double")).alias("within_one"))


def _survival_ranks(samples: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """(by, key, score, n): key orders by time, events before censored rows of the same time.

    Row i is comparable with row j exactly when i is an event and key_i < key_j.
    """
    rows = samples.select(*by, "time", F.col("event").cast("int").alias("event"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("time").isNotNull() & F.col("score").isNotNull() & F.col("event").isNotNull())
    times = rows.select(*by, "time").distinct().withColumn("one", F.lit(1))
    dense = running_totals(times, by, "time", {"r": "one"}).drop("one")
    key = (F.col("r") - 1) * 2 + (1 - F.col("event"))
    return rows.join(dense, [*by, "time"]).withColumn("key", key).groupBy(*by, "key", "event", "time", "score").agg(F.count(F.lit(1)).alias("n"))


def comparable_pairs(samples: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    """Per (by, event time): events there and the partners each of them is comparable with.

    Partners are rows with a later time, or censored at the same time; rows without a time or an
    event flag take no part. Only counts leave the operator; the pairs themselves would be quadratic.
    """
    by = list(by)
    samples = samples.where(F.col("time").isNotNull() & F.col("event").isNotNull())
    cells = samples.groupBy(*by, "time").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("bigint")).alias("n_events"))
    at = running_totals(cells, by, "time", {"ge": "n"}, ascending=False)
    return at.where("n_events > 0").select(*by, "time", "n_events", (F.col("ge") - F.col("n_events")).alias("n_partners"),
                                           (F.col("n_events") * (F.col("ge") - F.col("n_events"))).alias("n_pairs"))


def c_index(samples: DataFrame, score: str = "score", by: Sequence[str] = ("cohort",), rows_per_bucket: int | None = None) -> DataFrame:
    """Harrell's C: a higher score should mean an earlier event; score ties count one half.

    Exact without forming pairs, see ``dominance_pairs``. Rows with a null time, event or score
    count on neither side.
    """
    by = list(by)
    pts = cut_lineage(_survival_ranks(samples, by, score))  # read by several passes below
    asks = pts.withColumn("events", F.when(F.col("event") == 1, F.col("n")).otherwise(0))
    conc = dominance_pairs(asks, by, "key", "score", "n", "events", rows_per_bucket).withColumnsRenamed({"lt": "concordant", "eq": "tied"})
    pairs = comparable_pairs(samples.where(F.col(score).isNotNull()), by).groupBy(*by).agg(F.sum("n_pairs").alias("comparable"))
    out = pairs.join(conc, by, "left") if by else pairs.withColumn("concordant", conc.select("concordant").scalar()).withColumn("tied", conc.select("tied").scalar())
    return out.withColumn("c_index", F.when(F.col("comparable") > 0, (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable")))


def interp_grid(curves: DataFrame, by: Sequence[str], x: str, y: str, order: Column, n: int = 100) -> DataFrame:
    """Linear interpolation of every curve onto n equally spaced points of [0, 1].

    A point within 1e-9 of a grid position counts as lying on it. Points first collapse to the first and last point per grid cell, at most 2n per curve, so
    the window that looks for the neighbours of a grid point never sees a whole curve.
    """
    by = list(by)
    pt = F.struct(order.alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))
    cells = curves.withColumn("cell", F.ceil(F.round(F.col(x) * (n - 1), 9)).cast("int")).groupBy(*by, "cell").agg(F.min(pt).alias("head"), F.max(pt).alias("tail"))
    grid = cells.select(*by).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = grid.join(cells, [*by, "cell"], "left")
    w = Window.partitionBy(*by).orderBy("cell")
    up = F.last("tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first("head", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    g = F.col("cell") / F.lit(float(n - 1))
    a, b = F.col("a"), F.col("b")
    val = (
        F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"])
        .otherwise(a["y"] + (b["y"] - a["y"]) * (g - a["x"]) / (b["x"] - a["x"]))
    )
    return full.withColumns({"a": up, "b": down}).select(*by, F.col("cell").alias("point"), g.alias("x"), val.alias("y"))


def mean_curve_band(grid: DataFrame, by: Sequence[str] = ("model",), pin: bool = True) -> DataFrame:
    """Mean curve over splits with a one-std band clipped to [0, 1]; ROC curves are pinned to 0 and 1 at the ends."""
    by = list(by)
    last = grid.agg(F.max("point")).scalar()
    pts = grid.withColumn("__last", last)
    y = F.when(F.col("point") == 0, 0.0).otherwise(F.col("y")) if pin else F.col("y")
    agg = pts.withColumn("y", y).groupBy(*by, "point", "x", "__last").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.count(F.lit(1)).alias("n"))
    if pin:
        agg = agg.withColumn("mean", F.when(F.col("point") == F.col("__last"), 1.0).otherwise(F.col("mean")))
    return agg.select(*by, "point", "x", "mean", "std", F.greatest(F.col("mean") - F.col("std"), F.lit(0.0)).alias("lower"), F.least(F.col("mean") + F.col("std"), F.lit(1.0)).alias("upper"), "n")
