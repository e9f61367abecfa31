"""Sample similarity graphs and feature propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators.joins import top_features
from cohortia.operators.vectors import nearest_k, similarity_self_join
from cohortia.session import cut_lineage, forget


def threshold_graph(vecs: DataFrame, cutoff: float = 0.7, block_rows: int | None = None) -> DataFrame:
    """Undirected edges (both directions) between samples with cosine above ``cutoff``."""
    p = similarity_self_join(vecs, cutoff, block_rows)
    return p.select(F.explode(F.array(
        F.struct(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("similarity").alias("weight")),
        F.struct(F.col("id_b").alias("src"), F.col("id_a").alias("dst"), F.col("similarity").alias("weight")))).alias("e")).select("e.*")


def knn_graph(vecs: DataFrame, k: int = 10, block_rows: int | None = None) -> DataFrame:
    """Symmetrised k-nearest-neighbour graph, positive weights only."""
    nn = nearest_k(vecs, k, block_rows=block_rows).where("similarity > 0")
    both = nn.select(F.explode(F.array(
        F.struct(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("similarity").alias("weight")),
        F.struct(F.col("id_b").alias("src"), F.col("id_a").alias("dst"), F.col("similarity").alias("weight")))).alias("e")).select("e.*")
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def _normalised(edges: DataFrame, values: DataFrame, weighted: bool = True) -> DataFrame:
    """(src, dst, w) of D^-1/2 (A + I) D^-1/2; every sample of ``values`` has a self loop."""
    w = F.col("weight") if weighted else F.lit(1.0)
    nodes = values.select(F.col("sample_id").alias("src")).distinct()
    e = edges.select("src", "dst", w.alias("w")).unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w")))
    deg = e.groupBy(F.col("src").alias("n")).agg(F.sum("w").alias("deg"))
    return e.join(deg.select(F.col("n").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("n").alias("dst"), F.col("deg").alias("dd")), "dst").select(
        "src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def graph_propagate(edges: DataFrame, values: DataFrame, steps: int = 1, weighted: bool = True) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 X per step on long values(sample_id, feature_id, value).

    Self loops weigh 1. Each step joins edges with values on the source and sums per
    (target, feature); the sum combines map-side, so a hub is not gathered in one task.
    """
    norm = _normalised(edges, values, weighted)
    if steps > 1:
        norm = cut_lineage(norm)
    cur = values.select("sample_id", "feature_id", "value")
    for i in range(steps):
        last, cur = cur, norm.join(cur.withColumnRenamed("sample_id", "src"), "src").groupBy(F.col("dst").alias("sample_id"), "feature_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
        if i + 1 < steps:
            cur = cut_lineage(cur)
            forget(last)
    return cur


def propagate_vectors(edges: DataFrame, vecs: DataFrame, steps: int = 1, weighted: bool = True, width: int = 32) -> DataFrame:
    """``graph_propagate`` on vecs(sample_id, vec); returns the same columns.

    A step joins and sums ``width`` dimensions at a time, not one, so an edge costs one row for
    each such part. Missing dimensions and nulls add nothing and are 0 at the end.
    """
    given = vecs.where(F.size("vec") > 0).select("sample_id", "vec")
    norm = cut_lineage(_normalised(edges, given, weighted))
    size = given.where(F.col("sample_id").isNotNull()).agg(F.max(F.size("vec"))).first()[0] or 0
    parts = F.expr(f"transform(sequence(0, (size(vec) - 1) div {width}), c -> slice(vec, cast(c * {width} + 1 as int), {width}))")
    cur = given.select("sample_id", F.posexplode(parts).alias("c", "x"))
    sums = [F.sum(F.col("w") * F.get("x", F.lit(i))) for i in range(min(width, size))]
    for i in range(steps):
        last, cur = cur, norm.join(cur.withColumnRenamed("sample_id", "src"), "src").groupBy(F.col("dst").alias("sample_id"), "c").agg(F.array(*sums).alias("x"))
        if i + 1 < steps:
            cur = cut_lineage(cur)
            forget(last)
    packed = cur.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("m"))
    return packed.select("sample_id", F.expr(f"transform(sequence(0, {max(size, 1) - 1}), i -> coalesce(cast(get(element_at(m, cast(i div {width} as int)), i % {width}) as double), 0D))").alias("vec"))


def gene_pathway_edges(weights: DataFrame, genes: int = 10, pathways: int = 5, cutoff: float = 0.1) -> DataFrame:
    """Edges |weight| > cutoff among the most important genes and pathways; weights(feature_id, pathway_id, weight)."""
    size = F.sum(F.abs("weight"))
    g = top_features(weights.groupBy("feature_id").agg(size.alias("s")), "s", genes).select("feature_id")
    p = top_features(weights.groupBy("pathway_id").agg(F.avg(F.abs("weight")).alias("s")), "s", pathways, "pathway_id").select("pathway_id")
    return weights.where(F.abs("weight") > cutoff).join(g, "feature_id", "left_semi").join(p, "pathway_id", "left_semi").select("feature_id", "pathway_id", "weight")


def graph_features_classify(edges: DataFrame, vecs: DataFrame, steps: int = 2, learner=None, train: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, propagated vectors): K propagation steps, then a linear classifier (Wu et al. 2019).

    ``train`` lists the training samples; predictions cover the others, or all without it.
    """
    from cohortia.operators import learn

    smooth = propagate_vectors(edges, vecs, steps)
    out = cut_lineage(smooth.join(vecs.select("sample_id", "label"), "sample_id"))
    fit_on = out if train is None else out.join(train.select("sample_id"), "sample_id", "left_semi")
    rest = out if train is None else out.join(train.select("sample_id"), "sample_id", "left_anti")
    model = learn.fit(learner or learn.logreg(), fit_on)
    return model.transform(rest), out
