"""Clustering of vectors and of distance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators import lloyd
from cohortia.operators.vectors import euclidean
from cohortia.session import cut_lineage, forget


def nearest_reference_distance(dist: DataFrame, reps: DataFrame | None = None, exclude_self: bool = True) -> DataFrame:
    """(id, d): least distance of each item to any other item, or to the representatives (column ``id``)."""
    rows = dist if reps is None else dist.join(reps.select(F.col("id").alias("id_b")).distinct(), "id_b", "left_semi")
    if exclude_self and reps is None:
        rows = rows.where("id_a <> id_b")
    return rows.groupBy(F.col("id_a").alias("id")).agg(F.min("d").alias("d"))


def divergent_count(dist: DataFrame, reps: DataFrame, cutoff: float = 0.30) -> DataFrame:
    return nearest_reference_distance(dist, reps).agg(F.count_if(F.col("d") > cutoff).alias("n_divergent"), F.count(F.lit(1)).alias("n"))


def within_group_max(dist: DataFrame, labels: DataFrame) -> DataFrame:
    """Cluster size and largest distance between two members; labels(id, cluster)."""
    la = labels.select(F.col("id").alias("id_a"), F.col("cluster"))
    lb = labels.select(F.col("id").alias("id_b"), F.col("cluster"))
    return dist.join(la, "id_a").join(lb, ["id_b", "cluster"]).groupBy("cluster").agg(F.count_distinct("id_a").alias("size"), F.max("d").alias("max_distance"))


def distance_kernel(dist: DataFrame, scale: float = 2.0) -> DataFrame:
    """Similarity exp(-scale d / std of the partner's column)."""
    std = dist.groupBy("id_b").agg(F.stddev_samp("d").alias("__s"))
    return dist.join(std, "id_b").select("id_a", "id_b", F.when(F.col("__s") > 0, F.exp(-scale * F.col("d") / F.col("__s"))).alias("similarity"))


def nearest_to_centroid(vecs: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """Per cluster the member closest to the centre; the smaller id wins a tie at 9 digits. centres(cluster, centre)."""
    j = vecs.select("sample_id", "vec").join(labels.select(F.col("id").alias("sample_id"), "cluster"), "sample_id").join(centres, "cluster")
    d = j.withColumn("d", euclidean("vec", "centre"))
    return d.groupBy("cluster").agg(F.min_by("sample_id", F.struct(F.round("d", 9), "sample_id")).alias("id"), F.min("d").alias("d"))


def cluster_means(vecs: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, centre): coordinate means, summed per dimension with map-side combining."""
    j = vecs.select("sample_id", "vec").join(labels.select(F.col("id").alias("sample_id"), "cluster"), "sample_id")
    dims = j.select("cluster", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    return dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def _features(vecs: DataFrame) -> DataFrame:
    return vecs.select(F.col("sample_id").alias("id"), array_to_vector("vec").alias("features"))


def kmeans(vecs: DataFrame, k: int, seed: int = 42, max_iter: int = 300, starts: int = 10) -> tuple[DataFrame, DataFrame, float]:
    """(labels, centres, inertia) of the best of several starts of k-means; one that does not settle is an error."""
    centres, inertia = lloyd.best_runs(vecs, [k], starts, seed, max_iter)[k]
    table = vecs.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    return lloyd.assign(vecs, {k: centres}).select("id", "cluster"), table, inertia


def kmeans_elbow(vecs: DataFrame, ks: Sequence[int] = range(1, 31), seed: int = 42, max_iter: int = 300, starts: int = 10) -> DataFrame:
    """Inertia per k, all k and starts in one solve; k = 1 is the total squared deviation from the mean."""
    runs = lloyd.best_runs(vecs, ks, starts, seed, max_iter)
    return vecs.sparkSession.createDataFrame([(int(k), runs[int(k)][1]) for k in ks], "k int, inertia double")


def representatives(vecs: DataFrame, labels: DataFrame, centres: DataFrame, dist: DataFrame) -> DataFrame:
    """Per cluster the member nearest its centre, the size and the largest inner distance."""
    near = nearest_to_centroid(vecs, labels, centres)
    return near.join(within_group_max(dist, labels), "cluster").select("cluster", "id", "size", "max_distance")


def cluster_count_sweep(
    vecs: DataFrame, dist: DataFrame, ks: Sequence[int] = range(3, 100), cutoff: float = 0.30, seed: int = 42, variance: float | None = 0.95, max_iter: int = 300, starts: int = 10,
) -> DataFrame:
    """For each k: how many items lie farther than ``cutoff`` from every representative.

    Clusters are those of the components that hold ``variance``; None takes the vectors as they are. All k
    and starts share one solve, and one query judges all representatives.
    """
    if variance is not None:
        from cohortia.operators.learn import pca

        vecs = cut_lineage(pca(vecs, None, variance).scores)
    runs = lloyd.best_runs(vecs, ks, starts, seed, max_iter)
    placed = lloyd.assign(vecs, {k: c for k, (c, _) in runs.items()})
    reps = placed.groupBy("k", "cluster").agg(F.min_by("id", F.struct(F.round("d", 9), "id")).alias("id_b")).select("k", "id_b").distinct()
    near = dist.join(cut_lineage(reps), "id_b").groupBy("k", "id_a").agg(F.min("d").alias("d"))
    return near.groupBy("k").agg(F.count_if(F.col("d") > cutoff).alias("n_divergent"))


def hierarchical_clusters(vecs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k leaves of a divisive tree (bisecting k-means)."""
    return BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(d := _features(vecs)).transform(d).select("id", "cluster")


def _indexed(ids: DataFrame) -> DataFrame:
    """(id, idx): a stable 64-bit number per string id; a hash collision fails the job."""
    out = ids.select("id").distinct().withColumn("idx", F.xxhash64("id"))
    clash = out.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return clash.select(F.when(F.col("n") > 1, F.raise_error(F.lit("id hash collision")).cast("string")).otherwise(F.col("id")).alias("id"), "idx")


def spectral_clusters(edges: DataFrame, k: int = 6, max_iter: int = 20) -> DataFrame:
    """Power iteration clustering of a similarity graph(src, dst, weight)."""
    und = edges.where("src <> dst and weight > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.avg("weight").alias("weight"))
    idx = _indexed(und.select(F.col("a").alias("id")).union(und.select("b")))
    num = und.join(idx.select(F.col("id").alias("a"), F.col("idx").alias("src")), "a").join(idx.select(F.col("id").alias("b"), F.col("idx").alias("dst")), "b")
    labels = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight").assignClusters(num.select("src", "dst", "weight"))
    return labels.join(idx, labels.id == idx.idx).select(idx.id, "cluster")


def _signature(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) with the smallest id of the component, by alternating large-star and small-star.

    The two star steps of Kiveris et al. (2014) shrink the graph in a logarithmic number of
    rounds. Each round is two aggregates and two joins; a hub's neighbours are never collected
    into a list. Rounds are written to the shared folder.
    """
    cur = cut_lineage(edges.select(F.col("src").cast("string").alias("u"), F.col("dst").cast("string").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    done, sig = False, _signature(cur)
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        nxt = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        seen, sig = sig, _signature(nxt)
        forget(cur)
        cur = nxt
        done = seen == sig
        if done:
            break
    if not done:
        raise RuntimeError("components did not settle; raise max_rounds")
    comp = cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select(F.col("id").cast("string").alias("id")).distinct().join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def single_link_clusters(dist: DataFrame, cutoff: float = 0.35) -> DataFrame:
    """Single-linkage cut: connected components of pairs within ``cutoff``."""
    dist = cut_lineage(dist.where(F.col("d") <= cutoff).select("id_a", "id_b", "d").unionByName(
        dist.select("id_a", F.col("id_a").alias("id_b"), F.lit(None).cast("double").alias("d")).distinct()))
    edges = dist.where((F.col("id_a") < F.col("id_b")) & (F.col("d") <= cutoff)).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    return connected_components(edges, dist.select(F.col("id_a").alias("id")))


def medoid_assign(dist: DataFrame, medoids: DataFrame) -> DataFrame:
    """(id, medoid): the nearest medoid, the smaller id on a tie; medoids(id)."""
    m = medoids.select(F.col("id").alias("id_b"))
    return dist.join(m, "id_b", "left_semi").groupBy(F.col("id_a").alias("id")).agg(F.min_by("id_b", F.struct("d", "id_b")).alias("medoid"))


def medoid_update(dist: DataFrame, assigned: DataFrame) -> DataFrame:
    """(medoid, id): per cluster the member with the least mean distance to its members, 12 digits, then the smaller id."""
    a = assigned.select(F.col("id").alias("id_a"), "medoid")
    b = assigned.select(F.col("id").alias("id_b"), "medoid")
    mean = dist.join(a, "id_a").join(b, ["id_b", "medoid"]).groupBy("medoid", "id_a").agg(F.avg("d").alias("m"))
    return mean.groupBy("medoid").agg(F.min_by("id_a", F.struct(F.round("m", 12), "id_a")).alias("id"))


def k_medoids(dist: DataFrame, k: int, max_iter: int = 1000, seed: int = 42) -> DataFrame:
    """(id, medoid) by alternating assignment and update until the medoids stay.

    The k medoid ids are all that reaches the driver. Starts from the k first ids in seeded order.
    """
    from cohortia.operators.ordered import seeded_key

    spark = dist.sparkSession
    table = cut_lineage(dist.select("id_a", "id_b", "d"))
    start = table.select(F.col("id_a").alias("id")).distinct().orderBy(seeded_key(seed, "id")).limit(k).collect()
    current = sorted(r["id"] for r in start)
    for _ in range(max_iter):
        med = spark.createDataFrame([(m,) for m in current], "id string")
        nxt = sorted(r["id"] for r in medoid_update(table, medoid_assign(table, med)).collect())
        if nxt == current:
            break
        current = nxt
    else:
        raise RuntimeError(f"the medoids still move after {max_iter} rounds")
    return medoid_assign(table, spark.createDataFrame([(m,) for m in current], "id string"))
