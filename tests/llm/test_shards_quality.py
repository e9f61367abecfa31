import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortia.llm import quality, shards


@pytest.mark.parametrize(("n", "k"), [(1000, 16), (1003, 16), (5, 16), (1, 1)])
def test_shards_hold_the_mixture(spark, monkeypatch, n, k):
    monkeypatch.setattr(shards, "ROWS_PER_PART", 37)
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = shards.stratified_shards(rows, k).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(k)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source, total in Counter(r.source for r in got).items():
        inside = Counter(r.shard for r in got if r.source == source)
        assert all(abs(inside.get(s, 0) - total / k) <= 2 for s in range(k))
    again = shards.stratified_shards(rows.repartition(5), k).collect()
    assert sorted(again) == sorted(got)


def interleaved(rows, seed_order, k):
    """Shard and slot recomputed: rank within the source along the seeded order, sorted by fractional rank."""
    by = {}
    for r in sorted(rows, key=seed_order):
        by.setdefault(r[1], []).append(r)
    line = sorted((int((i + 0.5) / len(rs) * (1 << 40)), r[1] or "", r[1] is None, seed_order(r), r) for rs in by.values() for i, r in enumerate(rs))
    n, out = len(line), {}
    for p, (*_, r) in enumerate(line):
        s = p * k // n
        out[r[0]] = (s, p - -(-s * n // k))
    return out


@pytest.mark.parametrize("parts", [None, 5, 40_000, 3 << 23, 1 << 31])
def test_interleaving_recomputed_with_any_number_of_parts(spark, parts):
    """Parts above 2^23 stand for tables of more than 1.7e10 rows."""
    rows = [(k, None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{k % 5}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("doc_id").cast("string")), 4).alias("h")).collect()}
    want = interleaved(rows, lambda r: (hashes[r[0]], r[0]), 7)
    got = {r.doc_id: (r.shard, r.slot) for r in shards.stratified_shards(df, 7, parts=parts).collect()}
    assert got == want


def test_shard_columns_of_the_input_give_way(spark):
    df = spark.createDataFrame([(1, "a", 9, "x"), (2, "a", 9, "y")], "doc_id long, source string, shard int, slot string")
    got = shards.stratified_shards(df, 1)
    assert got.columns == ["doc_id", "source", "shard", "slot"]
    assert {(r.shard, r.slot) for r in got.collect()} == {(0, 0), (0, 1)}


def test_shards_of_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows).withColumnRenamed("lang", "shard0").withColumnRenamed("n_chars", "__h0")
    got = shards.stratified_shards(docs, 3).collect()
    assert len(got) == len(odd_rows) and sorted(Counter(r.shard for r in got).values()) == [3, 4, 4]
    assert shards.stratified_shards(make([]), 3).count() == 0


def counts(text, size=8):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = {}
    for k in range(len(words) - size + 1):
        found.setdefault(tuple(words[k : k + size]), []).append(k)
    covered = {j for v in found.values() if len(v) > 1 for k in v for j in range(k, k + size)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, make, odd_rows, sf):
    texts = [r[1] for r in odd_rows] + ["a b c d e f g h a b c d e f g h", "x " * 9, "l\nl\n\nl\r\nl", "a b c d e f g h i a b c d e f g h i j " * 3]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in quality.base_counts(make(rows)).collect()}
    for k, t in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), k
    assert quality.base_counts(make([])).count() == 0


def test_fences_follow_the_group(spark, make):
    plain = [(k, " ".join(f"word{k}{j}" for j in range(30)), "en", "web", 0) for k in range(100)]
    code = [(1000 + k, " ".join(f"w{k}{j} # $ %" for j in range(30)), "en", "code", 0) for k in range(100)]
    odd = [(5000, " ".join(f"w{j}###***" for j in range(30)), "en", "web", 0), (5001, "few words", "en", "web", 0)]
    rare = [(6000, " ".join(f"r{j}" for j in range(30)), "en", "new", 0), (6001, " ".join(f"r{j}" for j in range(30)), None, None, 0)]
    got = {r.doc_id: r for r in quality.adaptive_filter(quality.base_counts(make([*plain, *code, *odd, *rare]))).collect()}
    assert all(got[k].kept for k in range(100)) and all(got[1000 + k].kept for k in range(100))
    assert not got[5000].kept and not got[5000].base_failed
    assert not got[5001].kept and got[5001].base_failed
    assert not got[6000].base_failed and not got[6001].base_failed
    assert quality.adaptive_filter(quality.base_counts(make([]))).count() == 0
    assert not any(r.kept for r in quality.adaptive_filter(quality.base_counts(make([(1, "too few"), (2, None)]))).collect())


def test_distances_are_learnt(spark):
    # 100 even texts of 4.8 to 5.2 characters a word, one of 6.5; half of the other group holds symbols, one text more of them.
    rows = [(k, "en", "even", 100, 480 + k % 41, 0) for k in range(100)] + [(500, "en", "even", 100, 650, 0)]
    rows += [(1000 + k, "en", "code", 100, 500, 40 * (k % 2)) for k in range(100)] + [(1500, "en", "code", 100, 500, 70), (1501, "en", "code", 100, 500, 900)]
    # 15 of 100 texts repeat some words: the quartile range is 0, the outer one is not.
    rows += [(2000 + k, "de", "list", 100, 500, 10 if k < 15 else 0) for k in range(100)] + [(2500, "de", "list", 100, 500, 24)]
    counts = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long")
    counts = counts.selectExpr("*", "10L as n_lines", "0L as n_dup_lines", "0L as n_repeat_words")
    got = {r.doc_id for r in quality.adaptive_filter(counts).where("not kept").collect()}
    assert got == {500, 1501, 2500}
    ratios = quality._ratios(counts)
    by = {r["__source"]: r["__f"] for r in quality.adaptive_fences(ratios).collect()}
    assert by["even"].chars_per_word_by == "quartiles" and by["code"].symbols_per_word_by == "quartiles"
    assert by["list"].symbols_per_word_by == "group" and by["list"].dup_lines_by == "constant"


def test_main_path_stays_in_the_jvm(make, odd_rows):
    docs = make(odd_rows)
    for df in (quality.adaptive_filter(quality.base_counts(docs)), shards.stratified_shards(docs, 4)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString().replace("LocalTableScan", ""))
