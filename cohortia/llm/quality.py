"""Quality rules whose limits come from the data: quantile sketches per language and source.

Every document gets a few counts, made by array expressions inside the JVM. Mergeable sketches
of the ratios are built per (lang, source), merged up to the language and to all documents for
groups too small to speak for themselves, and give fences around the bulk of each group: as far out
as the quartile range or the outer quantiles say. A join on the group brings the fences back to the
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Ratios that are judged, with the distance of a fence from the quartiles where nothing can be learnt:
#: the quartiles and the outer quantiles of the group, its language and the whole are all the same value.
RATIOS = {"chars_per_word": 3.0, "symbols_per_word": 0.25, "dup_lines": 0.4, "repeat_words": 0.25}
#: Fences lie this many quartile ranges outside the quartiles.
REACH = 3.0
#: And no nearer than the range between this quantile and its counterpart, which lies inside them.
OUTER = 0.1
#: A group with fewer documents is judged by its language, a language with fewer by all.
LEAST_GROUP = 50
KLL_K = 400


def words_of(text: Column) -> Column:
    """Words between white space (0x20, 0x09-0x0D); a null or blank text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def base_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of
    ``#*$%&|<>``), ``n_lines`` (lines with a word), ``n_dup_lines`` (of these, equal to an
    earlier one) and ``n_repeat_words`` (words inside windows of ``window`` words that occur
    twice or more in the text, the first time included). A null text counts as empty.

    Windows are compared by 64-bit hashes chained over their words. Only texts in which some
    hash occurs twice pay for sorting their windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("__t"), words_of(F.col("text")).alias("__w"))
    base = base.withColumn("n_words", F.size("__w").cast("long"))
    whole = F.col("n_words") >= window
    hashes = F.when(whole, F.expr(f"transform(sequence(1, cast(n_words as int) - {window - 1}), i -> xxhash64(slice(__w, i, {window})))"))
    base = base.withColumn("__h", F.coalesce(hashes, F.array().cast("array<bigint>")))
    repeated = F.size("__h") > F.size(F.array_distinct("__h"))
    # Sorted (hash, place) pairs: a place is repeated when a neighbour has its hash.
    pairs = F.expr("array_sort(arrays_zip(__h, sequence(1, size(__h))))")
    places = F.expr(
        "array_sort(transform(filter(transform(__p, (x, i) -> struct(x.`1` as at,"
        " (i > 0 and get(__p, i - 1).__h = x.__h) or get(__p, i + 1).__h <=> x.__h as twice)), x -> x.twice), x -> x.at))"
    )
    covered = F.expr(f"aggregate(zip_with(__at, slice(__at, 2, size(__at)), (a, b) -> least(coalesce(b - a, {window}), {window})), 0L, (s, x) -> s + x)")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = base.withColumn("__l", lines)
    base = base.withColumn("__p", F.when(repeated, pairs)).withColumn("__at", F.when(F.col("__p").isNotNull(), places))
    return base.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _ratios(counts: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counts.select(
        "*",
        (F.col("word_chars") / words).alias("chars_per_word"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / lines).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _bulk(sketched: DataFrame) -> DataFrame:
    """Per ratio the outer quantiles and the quartiles of a group."""
    out = []
    for r in RATIOS:
        q = lambda p, r=r: F.when(F.col("__n") > 0, F.kll_sketch_get_quantile_double(f"__{r}", F.lit(p)))  # noqa: E731  an empty sketch has none
        out.append(F.struct(*[q(p).alias(n) for n, p in (("p_low", OUTER), ("q_low", 0.25), ("q_high", 0.75), ("p_high", 1 - OUTER))]).alias(r))
    return sketched.select("lang", "source", "__n", F.struct(*out).alias("bulk"))


def _fences(own: Column, lang: Column, total: Column) -> Column:
    """Fences of one group, and for each ratio what decided their distance.

    The distance is REACH quartile ranges, or the outer range if that is larger. A group whose
    outer range is 0 takes that of its language or of the whole; the constants of RATIOS are left
    for a ratio that is one value throughout. ``lang`` may be null.
    """
    out = []
    for r, least in RATIOS.items():
        ways = [("quartiles", REACH * (own[r].q_high - own[r].q_low))]
        ways += [(name, b[r].p_high - b[r].p_low) for name, b in (("group", own), ("language", lang), ("whole", total))] + [("constant", F.lit(least))]
        # The first of the outer ranges above 0 bounds the quartile range from below.
        outer = F.coalesce(*[F.when(w > 0, F.struct(w.alias("d"), F.lit(n).alias("by"))) for n, w in ways[1:]])
        reach = F.when(ways[0][1] >= outer.d, F.struct(ways[0][1].alias("d"), F.lit(ways[0][0]).alias("by"))).otherwise(outer)
        out += [F.least(own[r].p_low, own[r].q_low - reach.d).alias(f"{r}_low"), F.greatest(own[r].p_high, own[r].q_high + reach.d).alias(f"{r}_high"), reach.by.alias(f"{r}_by")]
    return F.when(own.isNotNull(), F.struct(*out))


def adaptive_fences(ratios: DataFrame) -> DataFrame:
    """Fences per (lang, source), taken from the smallest group that holds LEAST_GROUP documents, and what decided their distance.

    One sketch per ratio and (lang, source) is built in a single aggregation; those of a
    language, and of all, are merges of these small sketches and see no document again.
    """
    own = ratios.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.kll_sketch_agg_double(r, F.lit(KLL_K)).alias(f"__{r}") for r in RATIOS],
    )
    merged = [F.sum("__n").alias("__n"), *[F.kll_merge_agg_double(f"__{r}", F.lit(KLL_K)).alias(f"__{r}") for r in RATIOS]]
    lang = _bulk(own.groupBy("lang").agg(*merged).withColumn("source", F.lit(None).cast("string")))
    total = _bulk(own.agg(*merged).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    small = lambda d, tag: d.select(F.col("lang").alias(f"__lang_{tag}"), F.col("__n").alias(f"__n_{tag}"), F.col("bulk").alias(f"__b_{tag}"))
    joined = (
        _bulk(own)
        .join(small(lang, "l"), F.col("lang").eqNullSafe(F.col("__lang_l")), "left")
        .withColumn("__all", F.lit(1))
        .join(small(total, "a").withColumn("__all", F.lit(1)).drop("__lang_a"), "__all", "left")
    )
    lang_bulk = F.when(F.col("__n_l") >= LEAST_GROUP, F.col("__b_l"))
    chosen = F.when(F.col("__n") >= LEAST_GROUP, F.col("bulk")).otherwise(F.coalesce(lang_bulk, F.col("__b_a")))
    joined = joined.select("*", lang_bulk.alias("__lang_bulk"), chosen.alias("__own_bulk"))
    return joined.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), _fences(F.col("__own_bulk"), F.col("__lang_bulk"), F.col("__b_a")).alias("__f"))


def adaptive_filter(counts: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``.

    ``counts`` is read twice, once for the sketches and once for the verdict: pass a written
    table. Limits are learnt from the documents that pass the base rules. ``kept`` is false
    where the base rules fail or a ratio lies outside its fences; fences hold the quartiles of
    their own group with room to spare, so an even group loses nothing. Null lang and source
    are groups of their own. A group none of whose documents passes the base has no fences
    and keeps nothing.
    """
    ratios = _ratios(counts).withColumn("base_failed", base_failed())
    fences = adaptive_fences(ratios.where(~F.col("base_failed")))
    joined = ratios.join(fences, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & (F.col(r) >= F.col("__f")[f"{r}_low"]) & (F.col(r) <= F.col("__f")[f"{r}_high"])
    verdict = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(*counts.columns, "base_failed", verdict.alias("kept"))
