"""Per-feature tests and set-level statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions import tails
from cohortia.operators.ordered import average_ranks, quantiles, seeded_key
from cohortia.session import cut_lineage, written


#: A side no larger than this may be sent to every task.
SMALL_BYTES = 8 << 20
#: Of a permutation test: rows a task holds, rows it makes of them, and counts it keeps.
SHARE_ROWS, TASK_ROWS, MAX_CELLS = 1 << 19, 1 << 23, 1 << 18


def group_moments(values: DataFrame, samples: DataFrame, group: str = "label", zero_fill: bool = False, measured: DataFrame | None = None) -> DataFrame:
    """Per feature: n, mean and sample variance in group 1 and group 0.

    With ``zero_fill`` an absent cell is a measured zero: the moments of the present cells are
    merged with those of the zeros, so the long assay is never completed. ``measured`` names the
    samples of the assay (column sample_id) where that is cheaper than finding them in ``values``.
    """
    g = samples.select("sample_id", F.col(group).cast("int").alias("g")).where(F.col("g").isin(0, 1))
    rows = values.where(F.col("value").isNotNull()).select("sample_id", "feature_id", "value").join(g, "sample_id")
    aggs = []
    for k in (1, 0):
        v = F.when(F.col("g") == k, F.col("value"))
        aggs += [F.count(v).alias(f"c{k}"), F.avg(v).alias(f"a{k}"), F.var_pop(v).alias(f"v{k}")]
    per = rows.groupBy("feature_id").agg(*aggs)
    if zero_fill:
        known = (values if measured is None else measured).select("sample_id").distinct()
        sizes = g.join(known, "sample_id", "left_semi").agg(
            F.struct(F.count_if(F.col("g") == 1).alias("n1"), F.count_if(F.col("g") == 0).alias("n0"))).scalar()
        per = per.withColumn("z", sizes)
    out = {}
    for k in (1, 0):
        c, a, v = F.col(f"c{k}"), F.coalesce(f"a{k}", F.lit(0.0)), F.coalesce(f"v{k}", F.lit(0.0))
        n = F.col(f"z.n{k}") if zero_fill else c
        m2 = v * c + (a * a * c * (n - c) / n if zero_fill else F.lit(0.0))
        out |= {f"n{k}": n, f"mean{k}": F.when(n > 0, a * c / n), f"var{k}": F.when(n > 1, m2 / (n - 1))}
    return per.select("feature_id", *[e.alias(k) for k, e in out.items()])


def welch_t(
    values: DataFrame, samples: DataFrame, group: str = "label", alpha: float = 0.05, zero_fill: bool = False, measured: DataFrame | None = None,
) -> DataFrame:
    """Welch's t per feature, group 1 against group 0, with Cohen's d on the mean variance.

    The significant column and p come from a vectorised tail function over one row per feature.
    """
    m = group_moments(values, samples, group, zero_fill, measured)
    se1, se0 = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    se2 = se1 + se0
    pooled = F.sqrt((F.col("var1") + F.col("var0")) / 2)
    out = m.select(
        "feature_id", "n1", "n0", "mean1", "mean0", (F.col("mean1") - F.col("mean0")).alias("diff"),
        F.when(se2 > 0, (F.col("mean1") - F.col("mean0")) / F.sqrt(se2)).alias("t"),
        F.when(se2 > 0, se2 * se2 / (se1 * se1 / (F.col("n1") - 1) + se0 * se0 / (F.col("n0") - 1))).alias("df"),
        F.when(pooled > 0, (F.col("mean1") - F.col("mean0")) / pooled).otherwise(0.0).alias("d"))
    return out.withColumn("p", tails.t_pvalue("t", "df")).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def sort_tests(tests: DataFrame) -> DataFrame:
    """Significant first, then by p, then by effect size."""
    return tests.orderBy(F.desc("significant"), F.asc_nulls_last("p"), F.desc(F.abs("d")), "feature_id")


def group_mean_difference(values: DataFrame, samples: DataFrame, group: str = "label") -> DataFrame:
    m = group_moments(values, samples, group)
    diff = F.col("mean1") - F.col("mean0")
    return m.select("feature_id", "mean1", "mean0", diff.alias("diff"), F.abs(diff).alias("abs_diff"))


def permutation_test(samples: DataFrame, score: str, n: int = 1000, within: str | None = None, seed: int = 777, statistic: str = "mean_diff") -> DataFrame:
    """(true, mean_permuted, p): all permutations of binary labels at once.

    Permuting binary labels means drawing which rows are positive, so permutation i calls the
    first n1 rows of its own seeded order positive (n1 per ``within`` group). No rows are ordered for
    that: map-side counts per first digits of the seeded key find the digits at which the n1-th
    row lies, and only rows with exactly these digits are ranked. ``statistic`` is the difference of
    means or the AUC (via average ranks). p = (#{perm >= true} + 1) / (N + 1).
    """
    grp = [within] if within else []
    rows = samples.select("sample_id", "label", *grp, F.col(score).cast("double").alias("v"))
    if statistic == "auc":
        rows = average_ranks(rows, [], "v", "rk").withColumn("v", F.col("rk")).drop("rk")
    elif statistic != "mean_diff":
        raise ValueError(f"unknown statistic {statistic}")
    rows = cut_lineage(rows)
    sizes = rows.groupBy(*grp).agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("n1"))
    first = sizes.agg(F.max("c"), F.count(F.lit(1)), F.sum("c")).first()
    digits = min(4, max(1, int(math.log(max(first[0] or 1, 64) / 64, 16))))  # about 64 to 1,024 rows share them
    # A task has a share of the rows and a run of permutations, so its counts stay few and all tasks have work.
    shares = max(1, -(-(first[2] or 0) // SHARE_ROWS))
    share_rows = -(-max(first[2] or 0, 1) // shares)
    tasks = 4 * samples.sparkSession.sparkContext.defaultParallelism
    run = max(1, min(-(-n * shares // tasks), MAX_CELLS // max(1, 16**digits * first[1]), TASK_ROWS // share_rows))
    runs = -(-n // run)
    spread = rows.drop("label").withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    spread = spread.repartitionById(runs * shares, (F.col("__run") * shares + F.pmod(F.xxhash64("sample_id"), F.lit(shares))).cast("int"))
    keyed = spread.withColumn("perm", F.explode(F.sequence(F.col("__run") * run + 1, F.least((F.col("__run") + 1) * run, F.lit(n))))).drop("__run")
    keyed = keyed.withColumn("h", seeded_key(seed, "perm", "sample_id")).withColumn("bin", F.substring("h", 1, digits))
    bins = keyed.groupBy("perm", *grp, "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"))
    order = Window.partitionBy("perm", *grp).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumns({"c0": F.coalesce(F.sum("c").over(order), F.lit(0)), "s0": F.coalesce(F.sum("s").over(order), F.lit(0.0))})
    wanted = sizes.select(*grp, "n1")
    before = before.join(wanted, grp) if grp else before.withColumn("n1", wanted.scalar())
    # The last bin that starts before the n1-th row; everything before it is positive.
    edge = before.where(F.col("c0") < F.col("n1")).groupBy("perm", *grp).agg(F.max_by(F.struct("bin", "s0", (F.col("n1") - F.col("c0")).alias("left")), "bin").alias("e"))
    edge = cut_lineage(edge.select("perm", *[F.col(g).alias(f"__{g}") for g in grp], "e.*"))
    small = F.broadcast(edge) if n * (first[1] or 0) * 64 <= SMALL_BYTES else edge  # one row per permutation and group
    same = (keyed["perm"] == small["perm"]) & (keyed["bin"] == small["bin"])
    for g in grp:
        same = same & keyed[g].eqNullSafe(small[f"__{g}"])
    inside = keyed.join(small, same).select(keyed["perm"], *[keyed[g] for g in grp], "v", "h", "left")
    place = F.row_number().over(Window.partitionBy("perm", *grp).orderBy("h"))
    rest = inside.withColumn("k", place).where(F.col("k") <= F.col("left")).groupBy("perm").agg(F.sum("v").alias("s"))
    drawn = edge.groupBy("perm").agg(F.sum("s0").alias("s")).unionByName(rest).groupBy("perm").agg(F.sum("s").alias("s1"))
    true = rows.agg(F.struct(F.sum(F.col("v") * F.col("label")).alias("s1"), F.sum("label").alias("c1"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))).scalar()

    def stat(s1):
        c1, s, c = F.col("t.c1"), F.col("t.s"), F.col("t.c")
        return (s1 / c1 - (s - s1) / (c - c1)) if statistic == "mean_diff" else (s1 - c1 * (c1 + 1) / 2) / (c1 * (c - c1))

    per = drawn.withColumn("t", true).select(stat(F.col("s1")).alias("stat"), stat(F.col("t.s1")).alias("true"))
    hits = F.count_if(F.col("stat") >= F.col("true") - 1e-12)
    return per.agg(F.max("true").alias("true"), F.avg("stat").alias("mean_permuted"), ((hits + 1) / (n + 1.0)).alias("p"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both sides measured; a null on either side leaves the pair out."""
    x, y = (d.where(F.col("value").isNotNull()).select("sample_id", "feature_id", F.col("value").alias(c)) for d, c in ((a, "x"), (b, "y")))
    return x.join(y, ["sample_id", "feature_id"])


def _corr(x, y):
    """Pearson correlation, null when either side is constant."""
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))


def pearson_by_feature(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("r"))


def spearman_by_feature(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank correlation over the samples both sides measured, average ranks for ties."""
    j = _both(a, b)
    j = average_ranks(average_ranks(j, ["feature_id"], "x", "rx"), ["feature_id"], "y", "ry")
    return j.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), _corr("rx", "ry").alias("rho"))


def feature_cross_correlation(a: DataFrame, b: DataFrame, selected_a: Sequence[str], selected_b: Sequence[str]) -> DataFrame:
    """Correlation of every selected feature of one modality with every selected one of another.

    The selections are short lists: one row per sample holds the selected values of ``a`` as
    columns, so the work is (cells of b) x (features of a), never a self-join of the assay.
    """
    wide = a.where(F.col("feature_id").isin(list(selected_a))).groupBy("sample_id").agg(
        *[F.sum(F.when(F.col("feature_id") == f, F.col("value"))).alias(f"x{i}") for i, f in enumerate(selected_a)])
    j = b.where(F.col("feature_id").isin(list(selected_b))).select("sample_id", F.col("feature_id").alias("feature_b"), F.col("value").alias("y")).join(wide, "sample_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature_a"), F.col(f"x{i}").alias("x")) for i, f in enumerate(selected_a)])
    long = j.select("feature_b", "y", F.inline(pairs)).where(F.col("x").isNotNull())
    return long.groupBy("feature_a", "feature_b").agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("r"))


def clinical_association(values: DataFrame, samples: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Feature x covariate: correlation r for numbers, one-way ANOVA F for categories, with p."""
    j = values.select("sample_id", "feature_id", "value").join(samples.select("sample_id", *numeric, *categorical), "sample_id")
    parts = []
    for c in numeric:
        r = j.where(F.col(c).isNotNull()).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), _corr("value", F.col(c).cast("double")).alias("stat"))
        t = F.col("stat") * F.sqrt((F.col("n") - 2) / (1 - F.col("stat") * F.col("stat")))
        parts.append(r.select("feature_id", F.lit(c).alias("covariate"), F.lit("r").alias("kind"), "n", "stat", tails.t_pvalue(t, (F.col("n") - 2).cast("double")).alias("p")))
    for c in categorical:
        parts.append(anova_f(j, c).select("feature_id", F.lit(c).alias("covariate"), F.lit("F").alias("kind"), "n", F.col("f").alias("stat"), "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anova_f(joined: DataFrame, group: str) -> DataFrame:
    """One-way F per feature from per-group counts, means and variances."""
    cells = joined.where(F.col(group).isNotNull()).groupBy("feature_id", group).agg(F.count("value").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    s = cells.groupBy("feature_id").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("gm"),
        F.sum(F.col("c") * F.col("v")).alias("within"), F.sum(F.col("c") * F.col("m") * F.col("m")).alias("q"))
    between = F.greatest(F.col("q") - F.col("n") * F.col("gm") * F.col("gm"), F.lit(0.0))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.when((d1 > 0) & (d2 > 0) & (F.col("within") > 0), (between / d1) / (F.col("within") / d2))
    return s.select("feature_id", "n", f.alias("f"), tails.f_pvalue(f, d1.cast("double"), d2.cast("double")).alias("p"))


def latent_entropy(labels: DataFrame, col: str = "label") -> DataFrame:
    """Shannon entropy of the cells and its share of the maximum."""
    c = labels.groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    tot = c.agg(F.sum("c")).scalar()
    p = F.col("c") / F.col("t")
    agg = c.withColumn("t", tot).agg((-F.sum(p * F.log(p))).alias("entropy"), F.count(F.lit(1)).alias("k"))
    return agg.select("k", "entropy", F.when(F.col("k") > 1, F.col("entropy") / F.log("k")).otherwise(0.0).alias("evenness"))


def mse(a: DataFrame, b: DataFrame, by: str = "modality") -> DataFrame:
    j = a.select("sample_id", "feature_id", by, F.col("value").alias("x")).join(b.select("sample_id", "feature_id", F.col("value").alias("y")), ["sample_id", "feature_id"])
    return j.groupBy(by).agg(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("mse"), F.count(F.lit(1)).alias("n"))


def adjusted_rand(labels_a: DataFrame, labels_b: DataFrame) -> DataFrame:
    """ARI of two labelings of the same samples, from the contingency table."""
    j = labels_a.select("sample_id", F.col("label").alias("a")).join(labels_b.select("sample_id", F.col("label").alias("b")), "sample_id")
    cells = j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    idx = cells.agg(F.sum(c2("n"))).scalar()
    sa = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(c2("n"))).scalar()
    sb = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(c2("n"))).scalar()
    base = cells.agg(F.sum("n").alias("n")).withColumns({"i": idx, "sa": sa, "sb": sb})
    expected = F.col("sa") * F.col("sb") / c2("n")
    top = (F.col("sa") + F.col("sb")) / 2
    return base.select("n", F.when(top == expected, 1.0).otherwise((F.col("i") - expected) / (top - expected)).alias("ari"))


def _variance_prior(per: DataFrame, trend: bool, robust: bool) -> tuple[float, list[float]]:
    """Prior degrees of freedom and log-variance trend coefficients from per-feature variances.

    Moments of e = ln s2 - digamma(d/2) + ln(d/2) (Smyth 2004). ``trend`` fits a quadratic of
    the mean expression; ``robust`` winsorises the residuals at 5 % and 95 % and corrects the
    variance for normal data. Only a handful of sums reach the driver.
    """
    ok = per.where("s2 > 0 and df > 0")
    if ok.limit(1).count() == 0:
        return float("inf"), [0.0]
    mean_df = ok.agg(F.avg("df")).first()[0]
    shift = float(tails.digamma(mean_df / 2)[0]) - math.log(mean_df / 2)
    rows = ok.select((F.log("s2") - shift).alias("e"), F.col("avg_expr").alias("x"))
    m = rows.agg(F.avg("x"), F.coalesce(F.stddev_pop("x"), F.lit(0.0))).first()
    degree = 2 if trend and m[1] > 0 else 0
    z = (F.col("x") - m[0]) / (m[1] or 1.0)
    rows = rows.withColumn("z", z)
    pw = lambda k: F.pow("z", F.lit(float(k)))
    sums = rows.agg(*[F.sum(pw(k)).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.col("e") * pw(k)).alias(f"t{k}") for k in range(degree + 1)]).first()
    import numpy as np

    A = np.array([[sums[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    beta = np.linalg.lstsq(A, np.array([sums[f"t{i}"] for i in range(degree + 1)]), rcond=None)[0]
    fit = sum((F.lit(float(b)) * pw(i) for i, b in enumerate(beta)), F.lit(0.0))
    res = rows.select((F.col("e") - fit).alias("r"))
    n = sums["s0"]
    factor = 1.0
    if robust:
        q = quantiles(res, [], "r", {"lo": 0.05, "hi": 0.95}).first()
        res = res.select(F.greatest(F.lit(q["lo"]), F.least(F.lit(q["hi"]), F.col("r"))).alias("r"))
        # Variance of a standard normal winsorised at its 5 % and 95 % points.
        c = 1.6448536269514722
        factor = 1 / (0.9 - 2 * c * math.exp(-c * c / 2) / math.sqrt(2 * math.pi) + 0.1 * c * c)
    mom = res.agg(F.sum(F.col("r") * F.col("r")), F.avg("r")).first()
    evar = (mom[0] - n * mom[1] ** 2) / max(n - degree - 1, 1) * factor - float(tails.trigamma(mean_df / 2)[0])
    d0 = 2 * tails.trigamma_inverse(evar) if evar > 0 else float("inf")
    coef = [float(b) for b in beta]
    coef[0] += (float(tails.digamma(d0 / 2)[0]) - math.log(d0 / 2)) if math.isfinite(d0) else 0.0
    return d0, [m[0], m[1] or 1.0, *coef]


def limma_moderated_t(assay: DataFrame, samples: DataFrame, group: str = "label", trend: bool = True, robust: bool = True, zero_fill: bool = False, measured: DataFrame | None = None) -> DataFrame:
    """Two-group moderated t: per-feature variances shrink to a common prior (Smyth 2004; Phipson et al. 2016)."""
    m = group_moments(assay, samples, group, zero_fill, measured)
    df = F.col("n1") + F.col("n0") - 2
    s2 = (F.coalesce("var1", F.lit(0.0)) * (F.col("n1") - 1) + F.coalesce("var0", F.lit(0.0)) * (F.col("n0") - 1)) / df
    per = m.where("n1 > 0 and n0 > 0").select(
        "feature_id", "n1", "n0", (F.col("mean1") - F.col("mean0")).alias("log_fc"),
        ((F.col("mean1") * F.col("n1") + F.col("mean0") * F.col("n0")) / (F.col("n1") + F.col("n0"))).alias("avg_expr"), df.alias("df"),
        F.when(df > 0, s2).alias("s2"))
    per = cut_lineage(per)  # one row per feature; the prior takes several passes over it
    d0, coef = _variance_prior(per, trend, robust)
    if len(coef) == 1:
        prior = F.lit(0.0)
    else:
        z = (F.col("avg_expr") - coef[0]) / coef[1]
        prior = F.exp(sum((F.lit(b) * F.pow(z, F.lit(float(i))) for i, b in enumerate(coef[2:])), F.lit(0.0)))
    post = prior if math.isinf(d0) else (F.lit(d0) * prior + F.col("df") * F.col("s2")) / (F.lit(d0) + F.col("df"))
    unit = F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))
    total_df = F.lit(1e9) if math.isinf(d0) else F.col("df") + F.lit(d0)
    out = per.where(F.col("s2").isNotNull()).withColumns({"s2_post": post, "t_ordinary": F.when(F.col("s2") > 0, F.col("log_fc") / F.sqrt("s2") / unit)})
    out = out.withColumn("t", F.when(F.col("s2_post") > 0, F.col("log_fc") / F.sqrt("s2_post") / unit))
    return out.withColumn("p", tails.t_pvalue("t", total_df.cast("double")))


def edger_two_group(assay: DataFrame, samples: DataFrame, factors: DataFrame, group: str = "label", prior: float = 1.0, robust: bool = True, prior_df: float = 10.0) -> DataFrame:
    """Negative-binomial two-group test on counts scaled to a common effective library.

    Per-gene moment dispersion phi = (s2 - mu) / mu^2, shrunk towards the mean dispersion weighted
    by degrees of freedom; Wald z on the log ratio with the prior count added to both means.
    ``robust`` caps a gene's own dispersion from below at the shrunken value only, so outlying
    genes keep their larger dispersion.
    """
    assay = written(assay)
    eff = factors.select("sample_id", (F.col("lib") * F.col("factor")).alias("l"))
    mean_l = eff.agg(F.avg("l")).scalar()
    scaled = assay.join(eff.withColumn("ml", mean_l), "sample_id").withColumn("value", F.col("value") / F.col("l") * F.col("ml"))
    m = group_moments(scaled, samples, group, zero_fill=True).where("n1 > 1 and n0 > 1")
    m = cut_lineage(m)  # one row per feature; the common dispersion and the tests read it
    mu = (F.col("mean1") * F.col("n1") + F.col("mean0") * F.col("n0")) / (F.col("n1") + F.col("n0"))
    s2 = (F.col("var1") * (F.col("n1") - 1) + F.col("var0") * (F.col("n0") - 1)) / (F.col("n1") + F.col("n0") - 2)
    per = m.withColumns({"mu": mu, "df": F.col("n1") + F.col("n0") - 2}).where("mu > 0").withColumn("raw", F.greatest((s2 - F.col("mu")) / (F.col("mu") * F.col("mu")), F.lit(0.0)))
    common = per.agg((F.sum(F.col("raw") * F.col("mu")) / F.sum("mu"))).scalar()
    per = per.withColumn("common", common)
    shrunk = (F.col("df") * F.col("raw") + F.lit(prior_df) * F.col("common")) / (F.col("df") + prior_df)
    phi = F.when((F.col("raw") > 4 * F.col("common")), F.col("raw")).otherwise(shrunk) if robust else shrunk
    per = per.withColumn("dispersion", phi)
    var = lambda k: (1 / (F.col(f"mean{k}") + prior) + F.col("dispersion")) / F.col(f"n{k}")
    log_fc = F.log((F.col("mean1") + prior) / (F.col("mean0") + prior))
    per = per.withColumns({"log_fc": log_fc / math.log(2), "z": log_fc / F.sqrt(var(1) + var(0))})
    return per.select("feature_id", "mean1", "mean0", "dispersion", "log_fc", "z", tails.normal_pvalue("z").alias("p"))
