"""Shards that all show the mixture of the whole: proportional stratified interleaving.

Rows are shuffled by a seeded hash, ranked within their source, and placed at the fraction of
their source that lies before them. Sorting by that fraction interleaves the sources in
proportion, so every contiguous cut holds each source at its overall share (to within a row
or two). Cuts at equal positions give shards whose row counts differ by at most one.

No rank is one window over a source: hash order is cut into even parts, positions inside a
part are added to the counts of the parts before it, and the number of parts follows the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts, and parts whose counts one task sums.
ROWS_PER_PART, PARTS_PER_BLOCK = 2_000, 4_096
#: Row hashes are this many bits; a fraction is compared as rank * 2**FRACTION_BITS // source size.
HASH_BITS, FRACTION_BITS = 60, 40


def _positions(df: DataFrame, by: list[str], part: str, order: list[Column], out: str) -> DataFrame:
    """0-based position of each row within ``by`` along (part, order), by parts.

    Rows before a part are summed in two levels: parts inside a block of parts, and blocks.
    """
    inside = Window.partitionBy(*by, part).orderBy(*order)
    counts = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("__c")).withColumn("__block", F.expr(f"{part} div {PARTS_PER_BLOCK}"))
    within = Window.partitionBy(*by, "__block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*by, "__block").agg(F.sum("__c").alias("__c"))
    blocks = blocks.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__block").alias("__b_block"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__far"))
    of_block = F.col("__block") == F.col("__b_block")
    for c in by:
        of_block = of_block & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    before = counts.withColumn("__near", F.coalesce(F.sum("__c").over(within), F.lit(0))).join(blocks, of_block)
    before = before.select(*[F.col(c).alias(f"__k_{c}") for c in [*by, part]], (F.col("__near") + F.col("__far")).alias("__before"))
    same = F.lit(True)
    for c in [*by, part]:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    ranked = df.withColumn("__at", F.row_number().over(inside) - 1)
    return ranked.join(before, same).withColumn(out, F.col("__at") + F.col("__before")).drop("__at", "__before", *[f"__k_{c}" for c in [*by, part]])


def _part(value: str, bits: int, parts: int) -> Column:
    """Which of ``parts`` even parts a number of ``bits`` bits lies in; ascends with it, at any number of parts."""
    return F.floor(F.col(value) / F.lit(float(1 << bits)) * F.lit(float(parts))).cast("long")


def stratified_shards(rows: DataFrame, n_shards: int, key: str = "doc_id", stratum: str = "source", seed: int = 17, parts: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0 inside a shard).

    Shard sizes differ by at most one row. The order depends only on the seed and the rows, not
    on partitions: ties of the hash fall to the key, then to the other columns. A null key or
    stratum is a value of its own; repeated rows take consecutive places; an empty table stays
    empty; columns of ``rows`` named shard or slot give way to the new ones. Give narrow rows: everything
    in ``rows`` is shuffled three times, texts should stay out. ``parts`` is how many tasks' worth of rows the order
    is cut into, by default one per ROWS_PER_PART rows; the result does not depend on it.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    cols = rows.columns
    kept = [c for c in cols if c.lower() not in ("shard", "slot")]
    total = rows.count()
    parts = parts or total // ROWS_PER_PART + 1
    named = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__s"),
        F.col(stratum).isNull().alias("__null"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string")), 64 - HASH_BITS).alias("__h"),
        F.col(key).alias("__key"),
    )
    named = named.withColumn("__part", _part("__h", HASH_BITS, parts))
    tie = [F.col("__h"), F.col("__key"), F.col("__row")]
    ranked = _positions(named, ["__s", "__null"], "__part", tie, "__rank")
    sizes = named.groupBy("__s", "__null").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__s").alias("__s2"), F.col("__null").alias("__null2"), "__n")
    placed = ranked.join(sizes, (F.col("__s") == F.col("__s2")) & (F.col("__null") == F.col("__null2")))
    fraction = ((F.col("__rank") + 0.5) / F.col("__n") * F.lit(1 << FRACTION_BITS)).cast("long")
    placed = placed.select("__row", "__s", "__null", *["__h", "__key"], fraction.alias("__f"))
    placed = placed.withColumn("__part", _part("__f", FRACTION_BITS, parts))
    order = [F.col("__f"), F.col("__s"), F.col("__null"), *tie]
    at = _positions(placed, [], "__part", order, "__pos")
    shard = F.expr(f"cast((__pos * {n_shards}) div {max(total, 1)} as int)")
    start = F.expr(f"(cast(__shard as long) * {total} + {n_shards - 1}) div {n_shards}")
    return (
        at.withColumn("__shard", shard)
        .withColumn("__slot", F.col("__pos") - start)
        .select(*[F.col("__row")[c].alias(c) for c in kept], F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"))
    )
