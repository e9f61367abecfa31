"""Hand-made fixtures for edge cases the demo tables do not hold."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.functions import tails
from cohortia.operators import clinical as C
from cohortia.operators import cluster as K
from cohortia.operators import encode as E
from cohortia.operators import joins as J
from cohortia.operators import learn as L
from cohortia.operators import metrics as M
from cohortia.operators import pathway as P
from cohortia.operators import results as R
from cohortia.operators import select as Sel
from cohortia.operators import splits as S
from cohortia.operators import stats as T
from cohortia.operators import vectors as V
from cohortia.sources import bundle as B
from cohortia.sources import readers as IO


def test_tails():
    assert tails.t_two_sided([2.0, 0.0, 12.706], [10.0, 5.0, 1.0]) == pytest.approx([0.07338803, 1.0, 0.05], abs=1e-5)
    assert tails.f_upper([4.0], [2.0], [10.0]) == pytest.approx([(1 + 2 * 4.0 / 10) ** -5])  # closed form for two degrees
    assert tails.gammaincc([0.5, 2.0], [3.841459 / 2, 0.5]) == pytest.approx([0.05, 0.9097960], abs=1e-6)
    assert tails.digamma([1.0, 0.1]) == pytest.approx([-0.5772156649, -10.4237549404])
    assert tails.trigamma([1.0]) == pytest.approx([np.pi**2 / 6])
    assert tails.trigamma_inverse(float(tails.trigamma(3.7)[0])) == pytest.approx(3.7)


def test_hypergeometric(spark):
    f = spark.createDataFrame([(f"f{i}",) for i in range(10)], "feature_id string")
    m = f.where("feature_id < 'f4'").withColumn("pathway_id", F.lit("p"))
    r = P.pathway_enrichment(f.where("feature_id in ('f0', 'f1', 'f9')"), m, f).first()
    assert (r.size, r.overlap, r.selected, r.universe) == (4, 2, 3, 10)
    assert r.p == pytest.approx((6 * 6 + 4) / 120)


def test_missing_clinical_column_is_an_error(spark):
    with pytest.raises(ValueError, match="days_to_death"):
        C.select_clinical(spark.createDataFrame([("a",)], "bcr_patient_barcode string"), "PAAD")


def test_resolve_survival_needs_known_columns(spark):
    direct = spark.createDataFrame([(True, 10)], "Status boolean, Survival_in_days int")
    assert C.resolve_survival(direct).first()[2:] == (1, 10.0)
    with pytest.raises(ValueError):
        C.resolve_survival(spark.createDataFrame([(1,)], "x int"))


def test_other_vital_status_rows_leave(spark):
    df = spark.createDataFrame([("a", "Dead", 5, None), ("b", "Alive", None, 7), ("c", None, 1, 2), ("d", "Unknown", 1, 2)], "Barcode string, OS string, days_to_death int, days_to_last_follow_up int")
    out = C.os_flag_time(C.union_vital_status(df)).orderBy("Barcode").collect()
    assert [(r.Barcode, r.OS, r.OS_Time) for r in out] == [("a", 1, 5 / 365), ("b", 0, 7 / 365)]


def test_ordinal_encode(spark):
    df = spark.createDataFrame([(1, "NA"), (2, "iv"), (3, None)], "k int, s string")
    assert [r.s for r in E.ordinal_encode(df, "s").orderBy("k").collect()] == [4, 6, None]
    assert "s" not in E.ordinal_encode(df.where("k = 1"), "s").columns
    with pytest.raises(Exception, match="unknown s"):
        E.ordinal_encode(spark.createDataFrame([("v",), ("i",)], "s string"), "s").collect()


@pytest.mark.parametrize("cats, want", [(["a b", "c", "d", "NA"], ["x_a_b", "x_c", "x_d"]), (["a", "b", "NA"], ["x_b"]), (["a", "NA"], [])])
def test_one_hot_rules(spark, cats, want):
    assert E.one_hot(spark.createDataFrame([(c,) for c in cats], "x string"), "x").columns == want


def test_impute_mode_tie_and_even_median(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (None, None)], "v double, c string")
    assert E.impute(df, ["v"], ["c"]).where("v = 1.5").first().c == "a"


def test_standardise_on_training_rows_only(spark):
    a = spark.createDataFrame([("s1", "f", 1.0), ("s2", "f", 3.0), ("s3", "f", 9.0), ("s1", "g", 2.0), ("s2", "g", 2.0)], "sample_id string, feature_id string, value double")
    out = {(r.sample_id, r.feature_id): r.value for r in E.standardise(a, a.where("sample_id <> 's3'")).collect()}
    assert out == {("s1", "f"): -1.0, ("s2", "f"): 1.0, ("s3", "f"): 7.0, ("s1", "g"): 0.0, ("s2", "g"): 0.0}


def test_duplicate_weight_fails(spark):
    f = spark.createDataFrame([("a",)], "feature_id string")
    with pytest.raises(Exception, match="duplicate weight"):
        J.attach_weights(f, spark.createDataFrame([("a", 1.0), ("a", 2.0)], "feature_id string, weight double")).collect()


def test_jaccard_of_empty_sets(spark):
    e = spark.createDataFrame([], "item string")
    assert J.jaccard(e, e).first().jaccard == 0.0


def test_auc_against_pairs_and_monotone_map(spark):
    rng = np.random.default_rng(1)
    y, s, w = rng.integers(0, 2, 80), np.round(rng.normal(size=80), 1), rng.random(80) + 0.5
    df = spark.createDataFrame([("m", 0, int(a), float(b), float(c)) for a, b, c in zip(y, s, w)], "model string, split int, label int, score double, weight double")
    num = sum(w[i] * w[j] * ((s[i] > s[j]) + 0.5 * (s[i] == s[j])) for i in range(80) for j in range(80) if y[i] == 1 and y[j] == 0)
    want = num / (w[y == 1].sum() * w[y == 0].sum())
    assert M.roc_auc(df).first().roc_auc == pytest.approx(want)
    assert M.roc_auc(df.withColumn("score", F.exp("score"))).first().roc_auc == pytest.approx(want)


def test_interp_matches_numpy(spark):
    x, y = np.array([0.0, 0.0, 0.33, 0.33, 0.7, 1.0]), np.array([0.0, 0.2, 0.2, 0.6, 0.9, 1.0])
    df = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "model string, o int, x double, y double")
    got = [r.y for r in M.interp_grid(df, ["model"], "x", "y", F.col("o"), 11).orderBy("point").collect()]
    assert got == pytest.approx(np.interp(np.linspace(0, 1, 11), x, y))


def test_single_class_split_has_no_auc(spark):
    df = spark.createDataFrame([("m", 0, 1, 0.3), ("m", 0, 1, 0.4)], "model string, split int, label int, score double")
    assert M.roc_auc(df).first().roc_auc is None
    assert M.roc_curve(df).count() == 0


def test_folds_are_even_and_groups_stay_together(spark):
    df = spark.range(203).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 17).cast("string").alias("group_id"))
    sizes = S.repeated_stratified_kfold(df, 4, 3).groupBy("repeat", "label", "fold").count().groupBy("repeat", "label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert len(sizes) == 6 and all(r.d <= 1 for r in sizes)
    g = S.repeated_stratified_group_kfold(df, 4, 3)
    assert g.groupBy("repeat", "group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert g.count() == 609


def test_permuted_labels_keep_counts_within_groups(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") < 20).cast("int").alias("label"), (F.col("id") % 2).alias("g"))
    got = {(r.perm, r.g): r.s for r in S.permute_labels(df, 3, "g").groupBy("perm", "g").agg(F.sum("label").alias("s")).collect()}
    assert got == {(p, g): 10 for p in range(3) for g in (0, 1)}


def test_tmm_geometric_mean_is_one(spark):
    from cohortia.operators import normalise as N

    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"g{j}", float(rng.poisson(20 * (1 + i % 3)) + 1)) for i in range(6) for j in range(50)]
    f = N.tmm_factors(spark.createDataFrame(rows, "sample_id string, feature_id string, value double"))
    assert f.agg(F.avg(F.log("factor"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_zero_filled_moments(spark):
    a = spark.createDataFrame([("s1", "f", 4.0), ("s3", "f", 2.0), ("s2", "g", 1.0)], "sample_id string, feature_id string, value double")
    s = spark.createDataFrame([("s1", 1), ("s2", 1), ("s3", 0)], "sample_id string, label int")
    r = T.group_moments(a, s, zero_fill=True).where("feature_id = 'f'").first()
    assert (r.n1, r.mean1, r.var1, r.n0, r.mean0, r.var0) == (2, 2.0, 8.0, 1, 2.0, None)


def test_moderated_t_finds_the_shifted_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i}", f"f{j}", float(rng.normal(5 + (3 if j == 7 and i < 6 else 0), 1))) for i in range(12) for j in range(40)]
    a = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    s = spark.createDataFrame([(f"s{i}", int(i < 6)) for i in range(12)], "sample_id string, label int")
    assert Sel.select_limma(a, s, 1).first().feature_id == "f7"
    plain = T.limma_moderated_t(a, s, trend=False, robust=False)
    assert plain.where("s2_post is null or s2_post <= 0").count() == 0


@pytest.mark.parametrize("block_rows", [None, 7])
def test_nearest_k_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(str(i), [float(v) for v in X[i]]) for i in range(40)], "sample_id string, vec array<double>")
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    sim = U @ U.T
    np.fill_diagonal(sim, -9)
    got = {}
    for r in V.nearest_k(df, 3, block_rows=block_rows).collect():
        got.setdefault(int(r.id_a), set()).add(int(r.id_b))
    assert got == {i: set(np.argsort(-sim[i])[:3]) for i in range(40)}
    near = {r.id: r.d for r in V.nearest_vector_distance(df, block_rows=block_rows).collect()}
    D = np.linalg.norm(X[:, None] - X[None], axis=2) + np.eye(40) * 99
    assert [near[str(i)] for i in range(40)] == pytest.approx(D.min(1))


def test_identical_vectors_are_at_distance_zero(spark):
    df = spark.createDataFrame([("a", [1e3, 1.0]), ("b", [1e3, 1.0]), ("c", [0.0, 0.0])], "sample_id string, vec array<double>")
    assert {r.id: r.d for r in V.nearest_vector_distance(df).collect()}["a"] == 0.0


def test_components_of_a_path_and_isolated_nodes(spark):
    n = 60
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)] + [("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n + 1)] + [("x",), ("y",), ("z",)], "id string")
    got = {r.id: r.component for r in K.connected_components(edges, nodes).collect()}
    assert {got[f"n{i:03d}"] for i in range(n + 1)} == {"n000"}
    assert (got["x"], got["y"], got["z"]) == ("x", "x", "z")


def test_k_medoids_finds_two_groups(spark):
    pts = [0.0, 1.0, 2.0, 50.0, 51.0, 52.0]
    d = spark.createDataFrame([(str(i), str(j), abs(a - b)) for i, a in enumerate(pts) for j, b in enumerate(pts)], "id_a string, id_b string, d double")
    got = {r.id: r.medoid for r in K.k_medoids(d, 2).collect()}
    assert {got[str(i)] for i in range(3)} == {"1"} and {got[str(i)] for i in range(3, 6)} == {"4"}


def test_nearest_reference_distance_self_option(spark):
    d = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "b", 0.0)], "id_a string, id_b string, d double")
    assert {r.d for r in K.nearest_reference_distance(d).collect()} == {2.0}
    assert {r.d for r in K.nearest_reference_distance(d, exclude_self=False).collect()} == {0.0}


def test_feature_ranking_with_absent_features(spark):
    w = spark.createDataFrame([("m", 0, "a", 2.0), ("m", 0, "b", -3.0), ("m", 1, "a", 1.0)], "model string, split int, feature_id string, weight double")
    s = spark.createDataFrame([("m", 0, 0.9), ("m", 1, 0.7)], "model string, split int, value double")
    got = {r.feature_id: (r.frequency, r.mean_rank, r.mean_weight, round(r.mean_test_score, 6)) for r in R.feature_ranking(w, s).collect()}
    assert got == {"a": (2, 1.5, 1.5, 0.8), "b": (1, 1.5, -1.5, 0.7)}


def test_pca_reconstructs(spark):
    rng = np.random.default_rng(8)
    Z = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 4)) + 3
    df = spark.createDataFrame([(str(i), [float(v) for v in Z[i]]) for i in range(50)], "sample_id string, vec array<double>")
    lat = L.pca(df, None, 0.999)
    assert lat.loadings.shape[1] <= 2
    back = {(r.sample_id, r.feature_id): r.value for r in L.reconstruct(lat, list("abcd")).collect()}
    assert [back[("3", c)] for c in "abcd"] == pytest.approx(list(Z[3]), abs=1e-6)


def test_rfe_keeps_protected_features(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(80, 6))
    y = (X[:, 0] - X[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(str(i), [float(v) for v in X[i]], int(y[i])) for i in range(80)], "sample_id string, vec array<double>, label int")
    log = Sel.rfe(df, list("abcdef"), 3, 1, 99, L.linear_svm(1.0), ["f"])
    assert {r.feature_id for r in log.where("kept").collect()} == {"a", "b", "f"}


def test_elimination_schedule():
    assert Sel._next_count(2000, 10, 0.05, 1300) == 1900
    assert Sel._next_count(1310, 10, 0.05, 1300) == 1300
    assert Sel._next_count(1300, 10, 0.05, 1300) == 1299
    assert Sel._next_count(5, 5, 0.05, 1300) == 5


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,s1,s2\ng1,1.5,NA\ng2,,2\n')
    got = {(r.sample_id, r.feature_id): r.value for r in IO.read_matrix_long(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("s1", "g1"): 1.5, ("s2", "g1"): None, ("s1", "g2"): None, ("s2", "g2"): 2.0}
    flip = IO.read_matrix_long(spark, str(tmp_path / "m.csv"), orient="samples_x_features")
    assert {r.sample_id for r in flip.collect()} == {"g1", "g2"}
    (tmp_path / "d.csv").write_text("a,b,c\n0,1,2\n1,0,3\n2,3,0\n")
    assert {(r.id_a, r.id_b): r.d for r in IO.read_distance_matrix(spark, str(tmp_path / "d.csv")).collect()}[("b", "c")] == 3.0
    (tmp_path / "sets.txt").write_text("p1\tg1,g2\np2\t\n")
    assert [(r.pathway_id, r.feature_id) for r in IO.read_gene_sets(spark, str(tmp_path / "sets.txt")).collect()] == [("p1", "g1"), ("p1", "g2")]
    line = 'chr1\tx\tgene\t1\t2\t.\t+\t.\tgene_id "E1"; gene_type "lnc"; gene_name "N1";\n'
    with gzip.open(tmp_path / "g.gtf.gz", "wt") as f:
        f.write("#header\n" + line + line.replace("\tgene\t", "\texon\t") + line.replace(' gene_name "N1";', "").replace("E1", "E2"))
    assert {tuple(r) for r in IO.read_gtf_genes(spark, str(tmp_path / "g.gtf.gz")).collect()} == {("E1", "N1", "lnc"), ("E2", "", "lnc")}
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert IO.read_table(spark, str(tmp_path / "t.tsv"), "a int, b string", "\t").first() == (1, "x")
    assert IO.list_files(spark, str(tmp_path / "*.csv")).count() == 2


def test_write_results_and_bundle_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("s1", "f1", 1.0, "rna")], "sample_id string, feature_id string, value double, modality string")
    b = B.CohortBundle(a, a.select("sample_id"), a.select("feature_id"), {"cancer": "paad"})
    B.bundle_write(b, str(tmp_path / "b"))
    back = B.bundle_read(spark, str(tmp_path / "b"))
    assert back.meta == {"cancer": "paad"} and back.assay.collect() == a.collect()
    for fmt in ("parquet", "csv", "tsv"):
        IO.write_results(a, str(tmp_path / fmt), fmt)
    assert IO.read_table(spark, str(tmp_path / "tsv"), sep="\t").count() == 1
    named = B.default_names(spark.createDataFrame([(0, 3, 1.0)], "r int, c int, value double"), "r", "c").first()
    assert (named.sample_id, named.feature_id) == ("Sample_0", "Feature_3")


def test_permutation_p_of_a_clear_effect(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") < 20).cast("int").alias("label"), (-F.col("id")).cast("double").alias("v"))
    assert T.permutation_test(df, "v", 99).first().p == pytest.approx(0.01)
