import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortia.llm import toxicity


def crowd(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}" for _ in range(rng.randrange(10, 80))]
        toxic = k % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zorkface!", "Zorkface", "grumblehead,"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = crowd(900)
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = toxicity.train(docs, marks)
    assert 0 < len(weights.places) < 500
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    right = sum((got[k] >= toxicity.THRESHOLD) == bool(labels[k][2]) for k in held)
    assert right >= 0.98 * len(held)
    left = toxicity.drop_toxic(docs, weights)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k in got if got[k] < toxicity.THRESHOLD}


def test_held_out_labels_are_not_read(spark, make):
    rows, labels = crowd(300)
    docs = make(rows)
    other = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, q, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, other))
    assert np.array_equal(a.places, b.places) and np.array_equal(a.values, b.values) and a.bias == b.bias


def test_the_sample_is_bounded(spark, make):
    rows, labels = crowd(300)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(make(rows), marks, 40).count() <= 40


def test_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "toxic")
    none = spark.createDataFrame([(None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs, none)
    assert not len(weights.places)
    got = toxicity.score(docs, weights).collect()
    assert len(got) == len(odd_rows) and len({r.score for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(make([]), weights).count() == 0
    one_kind = toxicity.train(docs, spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, toxic int"))
    assert all(r.score > 0.99 for r in toxicity.score(docs, one_kind).collect())


def test_learning_by_hand():
    # Two documents; the place of the toxic one ends above zero, a shared place stays out under L1.
    rows = [np.array([1, 5]), np.array([5, 9])] * 40
    w = toxicity.fit_ftrl(rows, np.array([1.0, 0.0] * 40))
    by = dict(zip(w.places.tolist(), w.values))
    assert by[1] > 0 > by[9] and abs(by.get(5, 0.0)) < min(by[1], -by[9])


def test_score_query_columns(spark, sf):
    import __spark_entry__ as entry

    got = entry.queries()["op5_ftrl_toxicity"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert got.where((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0
