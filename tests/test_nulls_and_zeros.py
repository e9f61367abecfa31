"""Null values take no part, absent cells of count tables are zeros, failures are not results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import absent, clinical, encode, joins, learn, metrics, normalise, ordered, pathway, stats
from cohortia.sources import readers

CELLS = "sample_id string, feature_id string, value double"


@pytest.fixture(scope="module")
def matrix(spark):
    """A 12 x 7 count matrix, stored densely and sparsely."""
    rng = np.random.default_rng(1)
    X = rng.poisson(1.2, (12, 7)).astype(float)
    X[3] = 0
    X[3, 2] = 9
    dense = [(f"s{i}", f"f{j}", float(X[i, j])) for i in range(12) for j in range(7)]
    frame = lambda rows: spark.createDataFrame(rows, CELLS)
    return X, frame(dense), frame([r for r in dense if r[2] != 0])


def cells(df, keys=("sample_id", "feature_id"), value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


@pytest.mark.parametrize("op", [
    encode.standardise, normalise.clr, lambda a: joins.variance_filter(a, 1.0), normalise.normalize_total_log1p, normalise.relative_abundance,
    lambda a: normalise.log_cpm(a, normalise.tmm_factors(a)),
    lambda a: joins.collapse_duplicate_genes(a.withColumn("symbol", F.concat(F.lit("g"), F.substring("feature_id", 2, 1).cast("int") % 3))),
])
def test_dense_and_sparse_storage_agree(matrix, op):
    _, dense, sparse = matrix
    full, given = cells(op(dense)), cells(op(sparse))
    assert given and all(v == pytest.approx(full[k]) for k, v in given.items())
    zeros = cells(dense)
    assert all(zeros.get(k, full[k]) == 0 for k in set(full) - set(given))  # only zeros are left out


def test_summaries_of_both_storages(matrix):
    X, dense, sparse = matrix
    for df in (dense, sparse):
        for r in normalise.feature_distribution(df).collect():
            x = X[:, int(r.feature_id[1:])]
            assert (r.n, r["min"], r["max"]) == (12, x.min(), x.max())
            assert [r["mean"], r["std"], r.q25, r.median, r.q75] == pytest.approx([x.mean(), x.std(ddof=1), *np.quantile(x, [0.25, 0.5, 0.75])])
        assert cells(joins.feature_median(df), ["feature_id"], "median") == {(f"f{j}",): np.median(X[:, j]) for j in range(7)}
    a, b = ({r.sample_id: r.factor for r in normalise.tmm_factors(df).collect()} for df in (dense, sparse))
    assert a == pytest.approx(b)
    grid = cells(absent.complete_grid(sparse))
    assert grid == cells(dense)


def test_pathway_scores_of_both_storages(spark, matrix):
    X, dense, sparse = matrix
    members = spark.createDataFrame([(f"p{j % 2}", f"f{j}") for j in range(7)], "pathway_id string, feature_id string")
    Z = (X - X.mean(axis=0)) / np.where(X.std(axis=0) > 0, X.std(axis=0), 1)
    for df in (dense, sparse):
        got = cells(pathway.pathway_score(encode.standardise(df), members, absent=encode.standardised_zero(df)))
        assert got == pytest.approx({(f"s{i}", f"p{p}"): Z[i, p::2].mean() for i in range(12) for p in range(2)})


def test_all_zero_sample(spark):
    a = spark.createDataFrame([("s1", "f1", 0.0), ("s1", "f2", 0.0), ("s2", "f1", 3.0), ("s2", "f2", 1.0)], CELLS)
    lengths = spark.createDataFrame([("f1", 2.0), ("f2", 1.0)], "feature_id string, length double")
    for op in (normalise.normalize_total_log1p, normalise.relative_abundance, lambda x: normalise.tpm(x, lengths)):
        got = cells(op(a))
        assert got[("s1", "f1")] == got[("s1", "f2")] == 0.0 and got[("s2", "f1")] > 0


def test_null_times_events_and_scores(spark):
    rows = [("a", 1.0, 1, 9.0), ("b", 2.0, 1, 8.0), ("c", 3.0, 0, 7.0), ("d", None, 1, 1.0), ("e", 2.5, None, 1.0), ("f", 2.5, 1, None)]
    df = spark.createDataFrame(rows, "sample_id string, time double, event int, score double").withColumn("cohort", F.lit("x"))
    r = metrics.c_index(df).first()
    assert r.c_index == 1.0 and r.comparable == 3
    assert metrics.comparable_pairs(df.where("score is not null")).agg(F.sum("n_pairs")).first()[0] == 3


def test_null_cells(spark):
    a = spark.createDataFrame([(f"s{i}", "f1", float(i)) for i in range(5)] + [("s5", "f1", None), ("s0", "f2", None)], CELLS)
    b = spark.createDataFrame([(f"s{i}", "f1", float(i * i)) for i in range(6)], CELLS)
    r = stats.spearman_by_feature(a, b).first()
    assert (r.n, r.rho) == (5, pytest.approx(1.0))
    assert stats.pearson_by_feature(a, b).first().n == 5
    assert clinical.complete_features(a).count() == 0
    assert clinical.complete_features(b).count() == 6


def test_null_scores_have_no_weight(spark):
    p = spark.createDataFrame([("m1", 0, "s", 0.8), ("m2", 0, "s", None), ("m1", 0, "t", None)], "model string, split int, sample_id string, score double")
    got = {r.sample_id: (r.score, r.n_models) for r in joins.late_integration(p).collect()}
    assert got == {"s": (0.8, 1), "t": (None, 0)}
    a = spark.createDataFrame([("s", "f1", 2.0), ("s", "f2", None)], CELLS)
    m = spark.createDataFrame([("p", "f1"), ("p", "f2")], "pathway_id string, feature_id string")
    assert pathway.pathway_score(a, m).first().value == 2.0


def test_vectors_fill_gaps_and_refuse_double_cells(spark):
    a = spark.createDataFrame([("s1", "f1", 1.0), ("s1", "f4", 4.0), ("s2", "f3", None), ("s2", "f2", 2.0)], CELLS)
    got = {r.sample_id: list(r.vec) for r in readers.matrix_to_vectors(a, readers.feature_index(a), -1.0).collect()}
    assert got == {"s1": [1.0, -1.0, -1.0, 4.0], "s2": [-1.0, 2.0, -1.0, -1.0]}
    with pytest.raises(Exception, match="occurs twice"):
        readers.matrix_to_vectors(a.unionByName(a.limit(1)), readers.feature_index(a)).collect()


@pytest.mark.parametrize("parts", [5, 1000])
def test_quantile_brackets_in_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", parts)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=5000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = {"a": 0.1, "b": 0.5, "c": 0.93}
    r = ordered.quantiles(df, [], "v", probs, 200).first()
    assert [r[k] for k in probs] == pytest.approx(np.quantile(x, list(probs.values())))
    counts = df.groupBy("v").count()
    r = ordered.weighted_quantiles(counts, [], "v", "count", probs, parts * 10).first()
    assert [r[k] for k in probs] == pytest.approx(np.quantile(x, list(probs.values())))


def _vecs(spark, n=60):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((f"s{i:03d}", [float(v) for v in rng.normal(size=3) + y], y, f"g{i // 4}", 0.5 + (i % 3)))
    return spark.createDataFrame(rows, "sample_id string, vec array<double>, label int, group_id string, group_weight double")


def test_search_failures_are_errors(spark):
    folds = _vecs(spark).withColumn("fold", F.substring("sample_id", 4, 1).cast("int") % 2)
    with pytest.raises(Exception):
        learn.grid_search(folds, lambda C: learn.Learner("broken", lambda n: learn.logreg(C).make(n).setFeaturesCol("nothing")), {"C": [1.0]})
    single = _vecs(spark).withColumn("fold", F.col("label"))
    table, best, _ = learn.grid_search(single, learn.logreg, {"C": [1.0, 2.0]})
    assert best == {"C": 1.0} and all(r.mean_score is None for r in table.collect())


def test_study_keeps_groups_weights_and_lost_splits(spark):
    v = _vecs(spark)
    ids = ["a", "b", "c"]
    part = lambda s, test: v.select("sample_id", F.lit(s).alias("split"), F.when(test, "test").otherwise("train").alias("part"))
    outer = part(0, F.col("group_id") < "g3").unionByName(part(1, F.col("label") == 1))
    t = learn.nested_cv(v, ids, learn.logreg, {"C": [0.1, 1.0]}, outer, 2, inner_repeats=2)
    assert len(t.failures) == 1 and t.failures[0].startswith("split 1")
    scores = {(r.split, r.metric): r.value for r in t.split_scores.collect()}
    assert scores[(1, "roc_auc")] is None and scores[(0, "roc_auc")] > 0.5
    assert {r.weight for r in t.predictions.collect()} <= {0.5, 1.5, 2.5}


def test_count_tables_compute_their_assay_once(spark):
    """Medians, distributions and factors read their input many times; however it is made, its rows are computed once."""
    from cohortia.operators import joins, normalise, stats

    rows = [(f"s{i % 4}", f"f{i % 3}", float(i)) for i in range(12)]
    samples = spark.createDataFrame([(f"s{i}", i % 2) for i in range(4)], "sample_id string, label int")
    source = spark.createDataFrame(rows, "sample_id string, feature_id string, value double").coalesce(1)
    for job in (joins.feature_median, normalise.feature_distribution, normalise.tmm_factors,
                lambda a: joins.collapse_duplicate_genes(a.withColumn("symbol", F.lit("g"))),
                lambda a: stats.edger_two_group(a, samples, spark.createDataFrame([(f"s{i}", 20.0, 1.0) for i in range(4)], "sample_id string, lib double, factor double"))):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        job(source.mapInArrow(count, source.schema)).collect()
        assert seen.value == len(rows)


def test_groups_below_a_bucket_need_no_cut(spark, monkeypatch):
    """Many small groups are no reason to cut the axis, however many rows they have together."""
    from cohortia.operators import ordered

    rows = spark.range(400).select((F.col("id") % 40).alias("g"), F.floor(F.col("id") / 40).cast("double").alias("v"), F.lit(2).cast("long").alias("w"))
    cut = []
    real = ordered.bucket_splits
    monkeypatch.setattr(ordered, "bucket_splits", lambda *a, **k: cut.append(1) or real(*a, **k))
    got = ordered.weighted_quantiles(rows, ["g"], "v", "w", {"q": 0.5}, rows_per_bucket=20).collect()
    assert not cut and len(got) == 40 and {r["q"] for r in got} == {4.5}
    assert {r["q"] for r in ordered.weighted_quantiles(rows, ["g"], "v", "w", {"q": 0.5}, rows_per_bucket=4).collect()} == {4.5} and cut
