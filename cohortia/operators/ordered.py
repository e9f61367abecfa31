"""Order statistics and running sums that never sort a whole group in one task.

Everything in the library that needs a rank, a prefix sum or an exact quantile over
sample-sized groups goes through this module, because one group may hold a large part
of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000
SKETCH_ACCURACY = 10_000
#: Rows of one group that one task may order by their seeded key.
ROWS_PER_PART = 1 << 16


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches null keys, keeping the left key columns."""
    b = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(b[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return a.join(b, cond, how).drop(*[f"__r_{k}" for k in keys])


def bucket_splits(df: DataFrame, order: str, rows_per_bucket: int | None = None) -> list[float]:
    """Cut points of ``order`` that part all rows into buckets of about ``rows_per_bucket``.

    The number of buckets follows the rows without a limit; fewer rows than one bucket holds need
    no cut. One pass counts, another sketches the cut points; only these numbers reach
    the driver. Loops over an unchanged axis compute them once and pass them on.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    buckets = -(-df.count() // rows_per_bucket)
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    accuracy = max(SKETCH_ACCURACY, 10 * buckets)
    return sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), probs, accuracy)).first()[0] or []))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: dict[str, str],
    ascending: bool = True,
    rows_per_bucket: int | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` (output name -> column) along ``order`` within ``by``.

    ``df`` must be unique on (by, order): aggregate to distinct values first. The order axis is cut
    into buckets (equal values share one): sums run inside a bucket, bucket totals run across
    buckets, and the two are added. Without a cut point there is one bucket and nothing to add.
    """
    by = list(by)
    if splits is None:
        splits = _group_splits(df, by, order, rows_per_bucket)
    key = F.col(order).asc() if ascending else F.col(order).desc()
    if not splits:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(c).over(w).alias(o) for o, c in sums.items()])
    cols = df.columns
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__key", outputCol="__bucket", handleInvalid="keep")
    df = cut.transform(df.withColumn("__key", F.col(order).cast("double"))).drop("__key")
    inner = Window.partitionBy(*by, "__bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    bkey = F.col("__bucket").asc() if ascending else F.col("__bucket").desc()
    before = Window.partitionBy(*by).orderBy(bkey).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    offsets = totals.select(
        *by,
        "__bucket",
        *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums],
    )
    local = df.select(*df.columns, *[F.sum(c).over(inner).alias(f"__l_{o}") for o, c in sums.items()])
    joined = _same(local, offsets, [*by, "__bucket"])
    return joined.select(*cols, *[(F.col(f"__l_{o}") + F.col(f"__o_{o}")).alias(o) for o in sums])


def _group_splits(df: DataFrame, by: Sequence[str], order: str, rows_per_bucket: int | None) -> list[float]:
    """Cut points for running sums within ``by``: none where every group has at most the rows of a bucket."""
    if by and largest_group(df, by) <= (rows_per_bucket or ROWS_PER_BUCKET):
        return []
    return bucket_splits(df, order, rows_per_bucket)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact linearly interpolated quantiles (output name -> probability) per group.

    A mergeable sketch brackets every wanted rank, then only the values inside the
    brackets are sorted, in parts; values below are merely counted. The bracket is verified, so
    a wrong sketch fails the job instead of changing a result.
    """
    by = list(by)
    names, ps = list(probs), [float(p) for p in probs.values()]
    base = df.select(*by, F.col(value).cast("double").alias("__v"))
    base = base.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    slack = 8.0 / accuracy
    grid = [min(1.0, max(0.0, x)) for p in ps for x in (p - slack, p + slack)]
    n, b = F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", grid, accuracy).alias("__b")
    if by:
        joined = _same(base, base.groupBy(*by).agg(n, b), by)
    else:
        joined = (
            base.withColumn("__s", base.agg(F.struct(n, b).alias("s")).scalar())
            .select("__v", F.col("__s.__n").alias("__n"), F.col("__s.__b").alias("__b"))
        )
    whole = F.col("__n") <= accuracy
    bounds = F.array(*[
        F.struct(
            F.when(whole, F.lit(float("-inf"))).otherwise(F.col("__b")[2 * i]).alias("lo"),
            F.when(whole, F.lit(float("inf"))).otherwise(F.col("__b")[2 * i + 1]).alias("hi"),
        )
        for i in range(len(ps))
    ])
    picked = joined.select(*by, "__v", "__n", F.posexplode(bounds).alias("__i", "__r"))
    picked = picked.where(F.col("__v") <= F.col("__r.hi")).withColumn(
        "__k", F.when(F.col("__v") >= F.col("__r.lo"), F.col("__v"))
    )
    # The bracket is cut into parts of the value axis, so no task sorts more than about a bucket of it.
    parts = F.ceil(F.col("__n") * (2 * slack / ROWS_PER_BUCKET))
    inside = (F.col("__k") - F.col("__r.lo")) / (F.col("__r.hi") - F.col("__r.lo")) * parts
    part = F.when(F.col("__k").isNull(), -1).when(whole | (parts <= 1) | (F.col("__r.hi") <= F.col("__r.lo")), 0).otherwise(F.least(F.floor(inside), parts - 1))
    counts = picked.withColumn("__p", part.cast("long")).groupBy(*by, "__i", "__p", "__k").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    before = Window.partitionBy(*by, "__i").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "__i", "__p").agg(F.sum("__c").alias("__t"))
    totals = totals.select(*by, "__i", "__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    w = Window.partitionBy(*by, "__i", "__p").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    local = counts.withColumn("__l", F.sum("__c").over(w))
    joined = _same(local, totals, [*by, "__i", "__p"])
    p = F.element_at(F.array(*[F.lit(x) for x in ps]), F.col("__i") + 1)
    ranked = joined.withColumn("__cum", F.col("__l") + F.col("__o")).withColumn("__h", (F.col("__n") - 1) * p)
    lo, hi = F.floor("__h") + 1, F.ceil("__h") + 1
    sel = ranked.groupBy(*by, "__i").agg(
        F.min(F.when(F.col("__cum") >= lo, F.col("__k"))).alias("__a"),
        F.min(F.when(F.col("__cum") >= hi, F.col("__k"))).alias("__z"),
        F.max(F.when(F.col("__k").isNull(), F.col("__cum")).otherwise(0)).alias("__below"),
        F.max("__h").alias("__h"),
    )
    frac = F.col("__h") - F.floor("__h")
    bad = F.col("__a").isNull() | F.col("__z").isNull() | (F.col("__below") >= F.floor("__h") + 1)
    q = F.when(bad, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(
        F.col("__a") + frac * (F.col("__z") - F.col("__a"))
    )
    sel = sel.withColumn("__q", q)
    return sel.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(nm) for i, nm in enumerate(names)])


def weighted_quantiles(
    counts: DataFrame, by: Sequence[str], value: str, weight: str, probs: dict[str, float], rows_per_bucket: int | None = None
) -> DataFrame:
    """Quantiles like ``quantiles`` of values that occur ``weight`` times; unique on (by, value)."""
    by = list(by)
    rows = counts.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*by, F.col(value).cast("double").alias("__v"), F.col(weight).cast("long").alias("__w"))
    splits = _group_splits(rows, by, "__v", rows_per_bucket)
    cum = running_totals(rows, by, "__v", {"__cum": "__w"}, splits=splits)
    if not splits:  # each group is in one task already
        full = cum.withColumn("__n", F.sum("__w").over(Window.partitionBy(*by)))
    else:
        n = rows.groupBy(*by).agg(F.sum("__w").alias("__n"))
        full = _same(cum, n, by) if by else cum.withColumn("__n", n.select("__n").scalar())
    at = {}
    for k, p in enumerate(probs.values()):
        h = (F.col("__n") - 1) * float(p)
        at[f"__a{k}"] = F.min(F.when(F.col("__cum") >= F.floor(h) + 1, F.col("__v")))
        at[f"__z{k}"] = F.min(F.when(F.col("__cum") >= F.ceil(h) + 1, F.col("__v")))
    got = full.groupBy(*by, "__n").agg(*[e.alias(c) for c, e in at.items()])
    frac = lambda p: (F.col("__n") - 1) * float(p) - F.floor((F.col("__n") - 1) * float(p))
    return got.select(*by, *[(F.col(f"__a{k}") + frac(p) * (F.col(f"__z{k}") - F.col(f"__a{k}"))).alias(nm) for k, (nm, p) in enumerate(probs.items())])


def seeded_key(seed: object, *parts: object) -> Column:
    """md5 of ``seed|part|part...``, the library's reproducible random order."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("__c")).agg(F.max("__c")).first()[0] or 0


def seeded_rank(df: DataFrame, by: Sequence[str], key: Column, out: str = "rank", largest: int | None = None) -> DataFrame:
    """1-based position of each row in md5 order within ``by``.

    Leading hex digits split a group into even parts of at most about ``ROWS_PER_PART`` rows, so the
    position is the count of rows in earlier parts plus the position inside the own part; groups of
    at most one part are ordered at once and need no counts. ``largest`` bounds the rows of a group; callers whose rows
    repeat a smaller table know it from there.
    """
    by = list(by)
    digits, rows = 0, largest_group(df, by) if largest is None else largest
    while rows > ROWS_PER_PART << (4 * digits):
        digits += 1
    df = df.withColumn("__h", key)
    if not digits:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("__h")).cast("long")).drop("__h")
    df = df.withColumn("__p", F.substring("__h", 1, digits))
    local = df.withColumn("__l", F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__h")))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__c"))
        .select(*by, "__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    )
    joined = _same(local, offsets, [*by, "__p"])
    return joined.withColumn(out, F.col("__l") + F.col("__o")).drop("__h", "__p", "__l", "__o")


def seeded_first(df: DataFrame, by: Sequence[str], key: Column, n: Column, largest: int, out: str = "first") -> DataFrame:
    """Whether each row is one of the first ``n`` of its group in md5 order; ``n`` is computed from ``__n``, the group's rows.

    Nothing is ordered for that but a few rows: counts per leading hex digits, combined map-side, find the digits the n-th row
    has, and only rows with exactly these digits are ranked. ``df`` is read twice.
    """
    by, digits = list(by), 2
    while largest > ROWS_PER_PART << (4 * digits):
        digits += 1
    rows = df.withColumn("__h", key).withColumn("__p", F.substring("__h", 1, digits))
    counts = rows.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy(*by).orderBy("__p")
    place = counts.select(*by, "__p", F.sum("__c").over(run.rowsBetween(Window.unboundedPreceding, -1)).alias("__b"), F.sum("__c").over(Window.partitionBy(*by)).alias("__n"))
    place = place.select(*by, "__p", F.coalesce("__b", F.lit(0)).alias("__b"), n.alias("__k"))
    # The last part that starts before the n-th row; without any row to take, no part does.
    edge = place.where(F.col("__b") < F.col("__k")).groupBy(*by).agg(F.max_by(F.struct("__p", (F.col("__k") - F.col("__b")).alias("left")), "__p").alias("__e"))
    at = _same(rows, cut_lineage(edge), by, "left")
    inside = F.coalesce(F.col("__e.__p") == F.col("__p"), F.lit(False))
    sure = at.where(~inside).withColumn(out, F.coalesce(F.col("__p") < F.col("__e.__p"), F.lit(False)))
    ranked = at.where(inside).withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("__h")) <= F.col("__e.left"))
    return sure.unionByName(ranked).select(*df.columns, out)


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, out: str = "rank", rows_per_bucket: int | None = None
) -> DataFrame:
    """Rank of ``value`` within ``by``, ascending, ties sharing their average rank."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    cum = running_totals(counts, by, value, {"__cum": "__c"}, rows_per_bucket=rows_per_bucket)
    ranks = cum.select(*by, value, (F.col("__cum") - (F.col("__c") - 1) / 2.0).alias(out))
    return _same(df, ranks, [*by, value])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first whole row per key under ``order``; an aggregate, so rows combine map-side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def dominance_totals(
    points: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    values: dict[str, str],
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Per (by, x, y): sums over points with larger ``x`` and smaller or equal ``y``.

    ``points`` is unique on (by, x, y) and ``x`` is a non-negative integer rank. For every
    output ``o`` two columns appear: ``o_lt`` (strictly smaller y) and ``o_eq`` (equal y).
    No pair is ever formed: two different x values first differ in exactly one base-4
    digit, so each point is sent once per digit position and running sums along ``y`` inside
    a shared prefix count the partners there.
    """
    by = list(by)
    lev, grp = _digits(points, by, x)
    cols = [f"__{o}_{d}" for o in values for d in range(_BASE - 1)]
    cells = lev.groupBy(*grp, y).agg(*_above(values))
    splits = bucket_splits(points, y, rows_per_bucket)
    cum = running_totals(cells, grp, y, {f"{c}_cum": c for c in cols}, splits=splits)
    packed = cum.select(
        *grp, y,
        *[F.array(*[F.col(f"__{o}_{d}_cum") - F.col(f"__{o}_{d}") for d in range(_BASE - 1)], F.lit(0)).alias(f"__lt_{o}") for o in values],
        *[F.array(*[F.col(f"__{o}_{d}") for d in range(_BASE - 1)], F.lit(0)).alias(f"__eq_{o}") for o in values],
    )
    hit = _same(lev.select(*grp, y, x, "__d"), packed, [*grp, y])
    idx = (F.col("__d") + 1).cast("int")
    return hit.groupBy(*by, x, y).agg(
        *[F.sum(F.element_at(f"__lt_{o}", idx)).alias(f"{o}_lt") for o in values],
        *[F.sum(F.element_at(f"__eq_{o}", idx)).alias(f"{o}_eq") for o in values],
    )


_BASE, _BITS = 4, 2


def _digits(points: DataFrame, by: Sequence[str], x: str) -> tuple[DataFrame, list[str]]:
    """Each point once per base-4 digit of ``x``: its digit ``__d`` and the prefix above it."""
    top = points.agg(F.max(x)).first()[0]
    levels = 1
    while top is not None and (int(top) >> (_BITS * levels)) > 0:
        levels += 1
    lev = points.withColumn("__lv", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
    shifted = F.expr(f"shiftright(cast({x} as bigint), __lv * {_BITS})")
    lev = lev.withColumn("__d", F.pmod(shifted, F.lit(_BASE))).withColumn(
        "__px", F.expr(f"shiftright(cast({x} as bigint), (__lv + 1) * {_BITS})")
    )
    return lev, [*by, "__lv", "__px"]


def _above(values: dict[str, str]) -> list[Column]:
    """Per digit d the sum of every value whose digit is larger."""
    return [
        F.sum(F.when(F.col("__d") > d, F.col(c)).otherwise(0)).alias(f"__{o}_{d}")
        for o, c in values.items() for d in range(_BASE - 1)
    ]


def dominance_pairs(
    points: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    weight: str,
    asker: str,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Per ``by``: sums of asker x weight over ordered pairs with larger partner ``x``.

    ``lt`` counts partners with a smaller ``y``, ``eq`` those with an equal one. The same digit
    scheme as ``dominance_totals``, but the asking weights ride along per digit, so the sums
    close inside the cells and no point is joined back.
    """
    by = list(by)
    lev, grp = _digits(points, by, x)
    ask = [F.sum(F.when(F.col("__d") == d, F.col(asker)).otherwise(0)).alias(f"__q_{d}") for d in range(_BASE - 1)]
    cells = lev.groupBy(*grp, y).agg(*_above({"w": weight}), *ask)
    splits = bucket_splits(points, y, rows_per_bucket)
    cum = running_totals(cells, grp, y, {f"__c_{d}": f"__w_{d}" for d in range(_BASE - 1)}, splits=splits)
    lt = sum((F.col(f"__q_{d}") * (F.col(f"__c_{d}") - F.col(f"__w_{d}")) for d in range(_BASE - 1)), F.lit(0))
    eq = sum((F.col(f"__q_{d}") * F.col(f"__w_{d}") for d in range(_BASE - 1)), F.lit(0))
    return cum.groupBy(*by).agg(F.sum(lt).alias("lt"), F.sum(eq).alias("eq"))
