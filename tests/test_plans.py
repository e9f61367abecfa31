"""Plan shapes that must hold at any scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SQL = sorted(entry.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL)
def test_no_cartesian_join(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "most"), [("expression_etl", 6), ("collapse_duplicate_genes", 6), ("logrank", 2), ("single_link_clusters", 3), ("align_samples", 8), ("c_index", 6)])
def test_few_scans(spark, sf, name, most):
    assert plan(entry.queries()[name](spark, sf)).count("FileScan") <= most


def test_flagship_reads_only_needed_columns(spark, sf):
    text = plan(entry.queries()["flagship"](spark, sf))
    scans = [line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]
    assert scans and all("l_extendedprice" not in s for s in scans)


def test_filters_reach_the_scan(spark, sf):
    text = plan(entry.queries()["filter_protein_coding"](spark, sf))
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,STANDARD)]" in text


def test_repeated_tables_are_not_taken_for_small_ones(spark, tmp_path):
    """A table repeated n times keeps the estimated size of one; what is counted or ranked of it must not be broadcast."""
    from cohortia.operators import splits

    path = str(tmp_path / "samples")
    spark.range(500).selectExpr("cast(id as string) sample_id", "cast(id % 3 = 0 as int) label", "cast(id % 2 as int) event", "cast(id % 40 as string) group_id").write.parquet(path)
    df = spark.read.parquet(path)
    for out in (splits.permute_labels(df, 50), splits.fold_assign(df, 4, ["label"], 50)):
        assert "BroadcastExchange" not in plan(out)
    for out in (splits.survival_stratified_shuffle(df, 50), splits.survival_sample_from_group(df, 50)):
        assert "HashAggregate" not in plan(out)  # the only join is with one written row per split and stratum


def test_ranker_leaves_nothing_of_its_rounds(spark, tmp_path, monkeypatch):
    import os

    from cohortia import session
    from cohortia.operators import hazard

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    rows = [(str(i), [float(i % 7), float(i % 3)], float(1 + i % 11), int(i % 4 > 0)) for i in range(60)]
    hazard.survival_ranker(spark.createDataFrame(rows, "sample_id string, vec array<double>, time double, event int"), tol=0.05)
    assert len(os.listdir(tmp_path)) == 1  # the ranked rows


def test_permutations_are_spread_over_tasks(spark, monkeypatch):
    from cohortia.operators import stats

    monkeypatch.setattr(stats, "TASK_ROWS", 400)  # four permutations a task
    seen = []
    plain = type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda self, n, c: (seen.append(n), plain(self, n, c))[1])
    df = spark.range(100).selectExpr("cast(id as string) sample_id", "cast(id < 40 as int) label", "cast(id as double) v", "id % 2 g")
    spread = stats.permutation_test(df, "v", 50, "g").first()
    monkeypatch.undo()
    whole = stats.permutation_test(df, "v", 50, "g").first()
    assert seen[0] >= 13 and spread.true == whole.true and spread.mean_permuted == pytest.approx(whole.mean_permuted) and spread.p == whole.p


def test_latent_copies_grow_as_the_input(spark, monkeypatch):
    """Eight times the samples and features are 64 times the cells, yet eight times the rows that are shuffled for them."""
    from cohortia.operators import learn

    monkeypatch.setattr(learn, "TASK_CELLS", 8, raising=False)
    monkeypatch.setattr(learn, "MOST_TASKS", 16, raising=False)
    seen = []
    plain = type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, other, *how: (seen.append(self.count() + other.count()), plain(self, other, *how))[1])
    for k in (1, 8):
        x, l = {(s, c): float(1 + s % 5 + 2 * c) for s in range(20 * k) for c in (1, 2)}, {(c, f): 0.1 * (f % 7 - c) for f in range(60 * k) for c in (1, 2)}
        name = lambda tag, i: f"{tag}{i}" if i else None  # a key may be null
        scores = spark.createDataFrame([(name("s", s), c, v) for (s, c), v in x.items()], "sample_id string, component int, value double")
        loadings = spark.createDataFrame([(c, name("f", f), v) for (c, f), v in l.items()], "component int, feature_id string, loading double")
        got = learn.latent_sensitivity(scores, loadings, 2)
        cells = {(r.sample_id, r.feature_id): r.value for r in got.collect()}
        assert got.count() == len(cells) == 20 * 60 * k * k
        for s, f in ((0, 0), (0, 5), (7, 0), (20 * k - 1, 60 * k - 1)):
            assert cells[name("s", s), name("f", f)] == pytest.approx(sum((x[s, c] * l[c, f]) ** 2 for c in (1, 2)) ** 0.5)
    few, many = seen
    assert few > 0 and many <= 10 * few


def test_latent_copies_are_not_broadcast(spark):
    from cohortia.operators import learn

    scores = spark.createDataFrame([("s1", 1, 1.0), ("s2", 1, 2.0)], "sample_id string, component int, value double")
    loadings = spark.createDataFrame([(1, "f1", 0.5)], "component int, feature_id string, loading double")
    got = learn.latent_sensitivity(scores, loadings)
    assert "BroadcastExchange" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {("s1", "f1", 0.5), ("s2", "f1", 1.0)}
    assert learn.latent_sensitivity(scores.where("false"), loadings).count() == learn.latent_sensitivity(scores, loadings.where("false")).count() == 0
    assert {r.value for r in learn.latent_sensitivity(scores, loadings.withColumn("component", F.lit(3))).collect()} == {0.0}  # no component in common


def test_group_draws_shuffle_rows_once(spark, monkeypatch):
    """A group's rows meet before they are repeated for the splits; parts of a large group give the same draws."""
    from cohortia.operators import splits

    df = spark.range(400).selectExpr("cast(id as string) sample_id", "cast(id % 2 as int) event", "if(id % 3 = 0, 'big', concat('g', id % 50)) group_id")
    seen = []
    plain_cut = splits.cut_lineage
    monkeypatch.setattr(splits, "cut_lineage", lambda d: (seen.append(plan(d)), plain_cut(d))[1])
    one = splits.survival_sample_from_group(df, 20)
    drawn = seen[-1]
    assert "Generate explode" in drawn and "Exchange" not in drawn[: drawn.index("Generate explode")] and drawn.count("Exchange") == 1
    rows = {tuple(r) for r in one.collect()}
    assert len(rows) == 20 * df.select("group_id").distinct().count()
    monkeypatch.setattr(splits, "GATHERED_ROWS", 16)
    assert {tuple(r) for r in splits.survival_sample_from_group(df, 20).collect()} == rows
