"""The order primitives give the same answer however finely they cut the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", round(rng.gauss(0, 10), 1)) for _ in range(4000)]
    return data, spark.createDataFrame(data, "g string, v double").persist()


@pytest.mark.parametrize("rows_per_bucket", [None, 50])
@pytest.mark.parametrize("ascending", [True, False])
def test_running_totals(rows, rows_per_bucket, ascending):
    data, df = rows
    cells = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.v): r.c for r in O.running_totals(cells, ["g"], "v", {"c": "n"}, ascending, rows_per_bucket).collect()}
    for g, v in got:
        want = sum(1 for a, b in data if a == g and (b <= v if ascending else b >= v))
        assert got[(g, v)] == want


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_match_linear_interpolation(rows, accuracy):
    data, df = rows
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for r in O.quantiles(df, ["g"], "v", probs, accuracy).collect():
        vals = [v for g, v in data if g == r.g]
        assert [r[k] for k in probs] == pytest.approx([np.quantile(vals, p) for p in probs.values()])
    whole = O.quantiles(df, [], "v", probs, accuracy).first()
    assert [whole[k] for k in probs] == pytest.approx([np.quantile([v for _, v in data], p) for p in probs.values()])


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 2.0), (None, 5.0)], "g string, v double")
    assert {r.g: r.m for r in O.quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {"a": 1.5, None: 5.0}


def test_seeded_rank_is_a_permutation_in_hash_order(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") > 2000).cast("int"))
    got = O.seeded_rank(df, ["g"], O.seeded_key(1, "id")).withColumn("h", O.seeded_key(1, "id")).collect()
    for g in (0, 1):
        part = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in part] == list(range(1, len(part) + 1))
        assert [r.h for r in part] == sorted(r.h for r in part)


@pytest.mark.parametrize("rows_per_bucket", [None, 40])
def test_average_ranks(rows, rows_per_bucket):
    data, df = rows
    got = O.average_ranks(df, ["g"], "v", "rk", rows_per_bucket).select("g", "v", "rk").distinct().collect()
    for r in random.Random(1).sample(got, 200):
        vals = [v for g, v in data if g == r.g]
        assert r.rk == sum(v < r.v for v in vals) + (sum(v == r.v for v in vals) + 1) / 2


def test_first_row_keeps_whole_rows_and_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o int, w string")
    assert {(r.k, r.o, r.w) for r in O.first_row(df, ["k"], [F.col("o")]).collect()} == {("a", 1, "y"), (None, 3, "z")}


@pytest.mark.parametrize("rows_per_bucket", [None, 30])
def test_dominance_totals(spark, rows_per_bucket):
    rng = random.Random(5)
    pts = sorted({(rng.randrange(400), float(rng.randrange(30))) for _ in range(500)})
    df = spark.createDataFrame([(x, y, rng.randrange(1, 4)) for x, y in pts], "x int, y double, n int").persist()
    raw = [(r.x, r.y, r.n) for r in df.collect()]
    got = O.dominance_totals(df, [], "x", "y", {"c": "n"}, rows_per_bucket).collect()
    assert len(got) == len(raw)
    for r in got:
        assert r.c_lt == sum(n for x, y, n in raw if x > r.x and y < r.y)
        assert r.c_eq == sum(n for x, y, n in raw if x > r.x and y == r.y)


@pytest.mark.parametrize("rows_per_part", [1 << 16, 3])
def test_first_rows_and_ranks_are_those_of_a_whole_sort(spark, monkeypatch, rows_per_part):
    monkeypatch.setattr(O, "ROWS_PER_PART", rows_per_part)
    data = [(g, str(i % 290)) for i in range(300) for g in ("a", None)] + [("b", "x")]
    df = spark.createDataFrame(data, "g string, id string").withColumn("h", O.seeded_key(5, "id"))
    ranked = O.seeded_rank(df, ["g"], O.seeded_key(5, "id")).collect()
    got = O.seeded_first(df, ["g"], O.seeded_key(5, "id"), F.floor(F.col("__n") * 0.25 + 0.5), 300).collect()
    for g, n in (("a", 300), (None, 300), ("b", 1)):
        keys = sorted(r.h for r in got if r.g == g)
        assert len(keys) == n and sorted(r.h for r in got if r.g == g and r.first) == keys[: int(n * 0.25 + 0.5)]
        assert [r.h for r in sorted((r for r in ranked if r.g == g), key=lambda r: r["rank"])] == keys
        assert sorted(r["rank"] for r in ranked if r.g == g) == list(range(1, n + 1))
