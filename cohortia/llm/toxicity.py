"""Toxicity scores by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features are present or absent: single words, neighbouring words and words with one between,
lower-cased ASCII letters and every non-ASCII byte, hashed into 2**FEATURE_BITS places. Every
coordinate has its own learning rate and an L1 penalty that keeps most weights at exactly zero,
so a model is a short list of places and weights. Its size is bounded by the number of places
(12 bytes each at most), which is why it may be sent to every task.

The model is fitted on a bounded sample of labelled documents, MAX_ROWS at most, taken by a hash
of the doc_id; every document is then scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Alphabet, Words, alphabet, chunks, distinct, hash_words, mix, text_buffers
from .tables import small_batches

FEATURE_BITS = 20
#: From this score on a document counts as toxic.
THRESHOLD = 0.7
#: The most labelled documents that are learnt from, and the most toxic ones among them.
MAX_ROWS, MAX_TOXIC = 18_000, 6_000
EPOCHS = 4
#: L1 above EPOCHS: a feature seen in one document alone never gets a weight.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 7.0, 0.1
_U = np.uint64
_PAIR, _SKIP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


class Weights(NamedTuple):
    places: np.ndarray
    values: np.ndarray
    bias: float


def _letters() -> Alphabet:
    return alphabet(lower=True, letters=True)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of every feature occurrence."""
    h, n = words.hashes, len(words.hashes)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found = [(text, mix(h ^ _U(1)))]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        if n > gap:
            inside = text[gap:] == text[:-gap]
            found.append((text[:-gap][inside], mix(h[:-gap] * factor + h[gap:])[inside]))
    shift = _U(64 - FEATURE_BITS)
    return np.concatenate([t for t, _ in found]), np.concatenate([(x >> shift).astype(np.int32) for _, x in found])


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over documents given as arrays of distinct places, in the order given."""
    size = 1 << FEATURE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    def bias():
        return -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias(), -35, 35)))
            g = p - y
            b = bias()
            grown = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - grown / ALPHA * w
            n[at] += g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / ALPHA * b
            n[size] += g * g
    all_w = weights(np.arange(size))
    places = np.flatnonzero(all_w).astype(np.int32)
    return Weights(places, all_w[places], float(bias()))


def _document_places(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct places of every text of a column."""
    data, offsets = text_buffers(column)
    abc = _letters()
    for a, b in chunks(offsets):
        text, place = features(hash_words(data, offsets[a : b + 1], abc))
        keys = distinct(text.astype(np.int64) << FEATURE_BITS | place)[0]
        cuts = np.searchsorted(keys, np.arange(b - a + 1, dtype=np.int64) << FEATURE_BITS)
        places = (keys & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
        yield from (places[cuts[d] : cuts[d + 1]] for d in range(b - a))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, toxic and text of at most ``max_rows`` labelled documents outside the held-out third.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are taken; which of them, a hash of
    the doc_id decides. A doc_id labelled more than once is toxic if any label says so, and null
    doc_ids or labels teach nothing.
    """
    small_batches(docs.sparkSession)
    open_rows = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(open_rows).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    most = min(MAX_TOXIC, max_rows // 2)
    sample = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic <> 1").orderBy(*order).limit(max_rows - most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(sample), "doc_id")  # at most max_rows narrow rows


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Weights:
    """Fit the model on an executor; only its non-zero weights come to the driver.

    Without a labelled document, or with labels of one kind, the weights are empty and the bias
    gives the share of toxic labels (0 without any).
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [p.tobytes() for p in _document_places(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "places"])

    def fit(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("doc_id").to_numpy(), table.column("order").to_numpy()))
        y = table.column("toxic").to_numpy().astype(float)[order]
        views = []  # of the batches as they came: the sample is not copied
        for chunk in table.column("places").chunks:
            _, offsets, data = chunk.buffers()
            at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            views += [flat[a:b].view(np.int32) for a, b in zip(at, at[1:])]
        rows = [views[k] for k in order]
        if 0 < y.sum() < len(y):
            w = fit_ftrl(rows, y, epochs)
        else:
            w = Weights(np.zeros(0, np.int32), np.zeros(0), 35.0 if y.sum() else -35.0)
        return pa.table({"places": [w.places.tobytes()], "values": [w.values.astype(np.float64).tobytes()], "bias": [w.bias]})

    rows = training_rows(docs, labels, max_rows).mapInArrow(places, "doc_id long, toxic int, places binary")
    ordered = rows.select(F.lit(0).alias("one"), F.xxhash64("doc_id").alias("order"), "doc_id", "toxic", "places")
    got = ordered.groupBy("one").applyInArrow(fit, "places binary, values binary, bias double").collect()
    if not got:
        return Weights(np.zeros(0, np.int32), np.zeros(0), -35.0)
    return Weights(np.frombuffer(bytes(got[0].places), np.int32), np.frombuffer(bytes(got[0]["values"]), np.float64), got[0].bias)


class _Scorer:
    """Scores of a column of texts under given weights."""

    def __init__(self, places: np.ndarray, values: np.ndarray, bias: float):
        self.dense, self.bias, self.abc = np.zeros(1 << FEATURE_BITS), bias, _letters()
        self.dense[places] = values
        self.used = self.dense != 0

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        total = np.full(len(column), self.bias)
        for a, b in chunks(offsets):
            text, place = features(hash_words(data, offsets[a : b + 1], self.abc))
            hit = self.used[place]
            keys = distinct(text[hit].astype(np.int64) << FEATURE_BITS | place[hit])[0]
            total[a:b] += np.bincount(keys >> FEATURE_BITS, self.dense[keys & ((1 << FEATURE_BITS) - 1)], b - a)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null or empty text has the score of the bias alone.

    Nothing but the text enters a score. Other columns are left out; repeated rows are scored alike.
    """
    places, values, bias = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(places, values, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all its columns, without the rows whose text scores ``threshold`` or more."""
    places, values, bias = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(places, values, bias)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
