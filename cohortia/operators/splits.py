"""Seeded splits, folds and label permutations; the same seed gives the same rows anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.ordered import _same, largest_group, seeded_first, seeded_key, seeded_rank
from cohortia.session import cut_lineage

#: Rows one task makes of a table that is repeated.
ROWS_PER_TASK = 1 << 19
#: Rows of one group that are gathered in one row; more are gathered in parts.
GATHERED_ROWS = 1 << 12


def _repeat(samples: DataFrame, n: int, name: str = "repeat", rows: int | None = None) -> DataFrame:
    """Every row n times; ``rows``, the size of the table, spreads it over as many tasks as the repeats need."""
    if rows is not None and n > 1:
        most = max(1, min(rows, -(-rows * n // ROWS_PER_TASK)))
        samples = samples.repartition(most)
    return samples.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _sizes(samples: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows in all and rows of the largest group."""
    got = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("__c")).agg(F.sum("__c"), F.max("__c")).first()
    return got[0] or 0, got[1] or 0


def fold_assign(samples: DataFrame, k: int, strata: Sequence[str] = (), repeats: int = 1, seed: int = 777, id_col: str = "sample_id") -> DataFrame:
    """(…, repeat, fold): seeded rank inside the stratum modulo k, so fold sizes differ by at most one per stratum."""
    rows, largest = _sizes(samples, strata)
    ranked = seeded_rank(_repeat(samples, repeats, rows=rows), ["repeat", *strata], seeded_key(seed, "repeat", id_col), largest=largest)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def kfold(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return fold_assign(samples, k, (), 1, seed).drop("repeat")


def repeated_stratified_kfold(samples: DataFrame, k: int = 4, repeats: int = 25, seed: int = 777) -> DataFrame:
    return fold_assign(samples, k, ["label"], repeats, seed)


def repeated_stratified_group_kfold(samples: DataFrame, k: int = 4, repeats: int = 25, seed: int = 777, by: Sequence[str] = ()) -> DataFrame:
    """Whole groups share a fold; a group counts towards its majority class, the smaller label on a tie. Each value of ``by`` apart."""
    per = samples.groupBy(*by, "group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy(*by, "group_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    folds = fold_assign(groups, k, [*by, "label"], repeats, seed, "group_id").select(*by, "group_id", "repeat", "fold")
    return samples.join(folds, [*by, "group_id"]).select(*samples.columns, "repeat", "fold")


def _holdout(rows: DataFrame, by: Sequence[str], test: float, key: Column, largest: int) -> DataFrame:
    """Mark the first round(test * n) rows of the seeded order in every group, of at most ``largest`` rows, as test."""
    rows = rows.dropna("any", subset=list(by))
    marked = seeded_first(rows, by, key, F.floor(F.col("__n") * test + 0.5), largest)
    return marked.withColumn("part", F.when(F.col("first"), "test").otherwise("train")).drop("first")


def train_test_split(samples: DataFrame, fractions: dict[str, float], strata: str | None = None, seed: int = 42) -> DataFrame:
    """Assign every sample to a part; parts take consecutive shares of the seeded order, per stratum if given."""
    by = [strata] if strata else []
    sizes = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = seeded_rank(samples, by, seeded_key(seed, F.lit(0), "sample_id"))
    ranked = ranked.join(sizes, by) if by else ranked.withColumn("__n", sizes.scalar())
    names, cum, edges = list(fractions), 0.0, []
    for nm in names[:-1]:
        cum += fractions[nm]
        edges.append((nm, round(cum, 12)))
    part = F.lit(names[-1])
    for nm, c in reversed(edges):
        part = F.when(F.col("rank") <= F.floor(F.col("__n") * c + 0.5), nm).otherwise(part)
    return ranked.withColumn("part", part).select(*samples.columns, "part")


def survival_stratified_shuffle(samples: DataFrame, n: int = 100, test: float = 0.25, seed: int = 777) -> DataFrame:
    """n independent hold-outs stratified by event status."""
    rows, largest = _sizes(samples, ["event"])
    return _holdout(_repeat(samples, n, "split", rows), ["split", "event"], test, seeded_key(seed, "split", "sample_id"), largest)


def survival_sample_from_group(samples: DataFrame, n: int = 100, test: float = 0.25, seed: int = 777) -> DataFrame:
    """One sample per group and split, drawn by weight (exponential race), then a stratified hold-out.

    The rows of a group are gathered once and every split draws from them where they are, so rows are shuffled once, not n times.
    """
    rows, largest = _sizes(samples, ["group_id"])
    tasks = max(1, min(rows, -(-rows * n // ROWS_PER_TASK)))
    cols = [c for c in samples.columns if c not in ("split", "group_id")]
    of = lambda c: F.col("r")[c]

    def drawn(members: DataFrame, parts: Column) -> DataFrame:
        """(split, group_id, k, r): the first of each split in every part of a group."""
        dealt = members.withColumn("__part", F.pmod(F.xxhash64("sample_id"), parts)).repartition(tasks, "group_id", "__part")
        packed = dealt.groupBy("group_id", "__part").agg(F.collect_list(F.struct(*cols)).alias("__rs"))

        def entry(r: Column, i: Column) -> Column:
            u = (F.conv(F.substring(seeded_key(seed, F.lit("draw"), F.col("split"), r["sample_id"]), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
            return F.struct((-F.log(u) / (r["group_weight"] if "group_weight" in cols else F.lit(1.0))).alias("k"), r["sample_id"].alias("id"), i.alias("i"))

        each = packed.select("group_id", "__rs", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("split"))
        first = each.select("split", "group_id", "__rs", F.array_min(F.transform("__rs", entry)).alias("__m"))
        return first.select("split", "group_id", F.col("__m.k").alias("k"), F.get("__rs", F.col("__m.i")).alias("r"))

    if largest <= GATHERED_ROWS:
        one = drawn(samples, F.lit(1))
    else:  # parts of a large group draw apart, then the parts' first ones are compared
        large = cut_lineage(samples.groupBy("group_id").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > GATHERED_ROWS).select("group_id", F.ceil(F.col("__c") / GATHERED_ROWS).alias("__parts")))
        sized = _same(samples, large, ["group_id"], "left")
        best = drawn(sized.where("__parts IS NOT NULL"), F.col("__parts")).groupBy("split", "group_id").agg(F.min_by(F.struct("k", "r"), F.struct("k", of("sample_id"))).alias("b"))
        one = drawn(sized.where("__parts IS NULL"), F.lit(1)).unionByName(best.select("split", "group_id", "b.*"))
    one = cut_lineage(one.select("split", "group_id", "r.*"))
    return _holdout(one, ["split", "event"], test, seeded_key(seed, "split", "sample_id"), largest_group(one, ["split", "event"]))


def repeated_survival_stratified_kfold(samples: DataFrame, k: int = 4, repeats: int = 5, seed: int = 777) -> DataFrame:
    return fold_assign(samples, k, ["event"], repeats, seed)


def permute_labels(samples: DataFrame, n: int, within: str | None = None, seed: int = 777) -> DataFrame:
    """(perm, sample_id, label): labels reassigned by matching two independent seeded orders."""
    grp = [within] if within else []
    samples = samples.select("sample_id", "label", *grp)
    count, largest = _sizes(samples, grp)
    rows = _repeat(samples, n, "perm", count)
    to = seeded_rank(rows, ["perm", *grp], seeded_key(seed, F.lit("to"), "perm", "sample_id"), "pos", largest)
    frm = seeded_rank(rows, ["perm", *grp], seeded_key(seed, F.lit("from"), "perm", "sample_id"), "pos", largest)
    # Either side is n tables long, which its estimated size does not tell: a broadcast would pass all through the driver.
    return to.drop("label").join(frm.select("perm", *grp, "pos", "label").hint("merge"), ["perm", *grp, "pos"]).select("perm", "sample_id", *grp, "label")
