"""Benchmark decontamination: rare n-gram seeds find passages, local alignment scores them.

The benchmark is the query set; it is taken in blocks of bounded size and every block is held
against all documents, so nothing is shuffled but word counts and no passage, however often it
was copied, gathers in one place. Seeds are the n-grams of an item that chance would hardly write:
their expected number, from word counts over the whole corpus, is at most RARE. As that rests on the
size of the corpus, the rarest of every NEIGHBOURS n-grams in a row is one too: these depend on shares of words
only, lie all over the item, and no edit removes more than its own neighbourhood. Copies of an
item raise no n-gram's expected number, so a leak in a third of all documents stays a leak. Where
seeds hit, the words around them are aligned with the item by Smith-Waterman.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Members, alphabet, chunks, hash_words, mix, text_buffers
from .tables import small_batches

#: Words of a seed; expected chance occurrences of a rare one; n-grams in a row of which the rarest is always a seed.
SEED, RARE, NEIGHBOURS = 3, 0.01, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score, as a share of a perfect copy's, from which a passage is a leak.
THRESHOLD = 0.5
#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 4 << 20
_U = np.uint64
_ABC = alphabet(lower=True, letters=True, digits=True)


class Items(NamedTuple):
    """One block of the benchmark: item ids and the word hashes of each."""

    ids: list[int]
    words: list[np.ndarray]


class Seeds(NamedTuple):
    """Seed hashes by length, and where in which items they lie."""

    size: int
    hashes: np.ndarray
    item: np.ndarray
    offset: np.ndarray


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes``; items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        data, offsets = text_buffers(pa.array([r.text for r in got], pa.string()))
        words = hash_words(data, offsets, _ABC)
        full = [i for i in range(len(got)) if words.first[i + 1] > words.first[i]]
        if full:
            yield Items([got[i].item_id for i in full], [words.hashes[words.first[i] : words.first[i + 1]] for i in full])


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(words) - size + 1, _U)
    for k in range(size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return out


def word_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray, int]:
    """The block's distinct word hashes, how often each occurs in ``docs``, and the words of ``docs`` in all."""
    small_batches(docs.sparkSession)
    vocabulary = Members(np.concatenate(items.words))
    values = vocabulary.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, counts, total = Members(values), np.zeros(len(values), np.int64), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                words = hash_words(data, offsets[a : b + 1], _ABC)
                at = members.find(words.hashes)
                counts += np.bincount(at[at >= 0], minlength=len(values))
                total += len(words.hashes)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], ["at", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(values), np.int64), 0
    for r in got:  # one row a distinct word of the block
        if r.at < 0:
            total = r.n
        else:
            counts[r.at] = r.n
    return values, counts, total


def choose_seeds(items: Items, values: np.ndarray, counts: np.ndarray, total: int) -> list[Seeds]:
    """Rare n-grams of every item, and the rarest of any NEIGHBOURS in a row; short items are one seed."""
    found: dict[int, list[tuple]] = {}
    for k, words in enumerate(items.words):
        size = min(SEED, len(words))
        share = np.log((counts[np.searchsorted(values, words)] + 1.0) / (total + 1.0))
        sums = np.concatenate([[0.0], np.cumsum(share)])
        expected = sums[size:] - sums[:-size] + np.log(total + 1.0)
        runs = np.lib.stride_tricks.sliding_window_view(expected, min(NEIGHBOURS, len(expected)))
        chosen = expected <= np.log(RARE)
        chosen[np.arange(len(runs)) + runs.argmin(axis=1)] = True
        chosen = np.flatnonzero(chosen)
        found.setdefault(size, []).append((_grams(words, size)[chosen], np.full(len(chosen), k), chosen))
    out = []
    for size, parts in found.items():
        h, item, offset = (np.concatenate([p[j] for p in parts]) for j in range(3))
        order = np.argsort(h, kind="stable")
        out.append(Seeds(size, h[order], item[order], offset[order]))
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the end of it in ``text``."""
    n = len(text)
    slope = GAP * np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new - slope) + slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Finder:
    """Leaks of one block of items in texts given as word hashes."""

    def __init__(self, items: Items, seeds: list[Seeds], threshold: float):
        self.items, self.threshold = items, threshold
        self.seeds = []
        for s in seeds:
            members = Members(s.hashes)
            first = np.searchsorted(s.hashes, members.values)
            self.seeds.append((s, members, first, np.searchsorted(s.hashes, members.values, side="right")))

    def hits(self, words) -> np.ndarray:
        """Rows (text, item, estimated first word of the passage), sorted and distinct."""
        out = []
        counts = np.diff(words.first)
        text = np.repeat(np.arange(len(counts)), counts)
        for s, members, first, last in self.seeds:
            if len(words.hashes) < s.size:
                continue
            at = members.find(_grams(words.hashes, s.size))
            pos = np.flatnonzero((at >= 0) & (text[: len(at)] == text[s.size - 1 :]))
            if not len(pos):
                continue
            a, n = first[at[pos]], (last - first)[at[pos]]
            place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pos = np.repeat(pos, n)
            out.append(np.stack([text[pos], s.item[place], pos - s.offset[place]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def leaks(self, words) -> Iterator[tuple[int, int, float, int, int, int]]:
        """Per leak: text, item number, score, first and last word in the text, seeds that agree."""
        hits = self.hits(words)
        if not len(hits):
            return
        length = np.array([len(w) for w in self.items.words])
        # Seeds of one passage estimate nearly the same start; farther starts are another passage.
        apart = (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0) | (np.diff(hits[:, 2]) > length[hits[1:, 1]] // 2 + 8)
        edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(hits)]])
        for a, b in zip(edges, edges[1:]):
            d, k = int(hits[a, 0]), int(hits[a, 1])
            item = self.items.words[k]
            pad = len(item) // 4 + 4
            lo = max(int(hits[a, 2]) - pad, int(words.first[d]))
            hi = min(int(hits[b - 1, 2]) + len(item) + pad, int(words.first[d + 1]))
            region = words.hashes[lo:hi]
            score, end = align(item, region)
            share = score / (MATCH * len(item))
            if share >= self.threshold:
                _, back = align(item[::-1], region[:end][::-1])
                base = lo - int(words.first[d])
                yield d, k, share, base + end - back, base + end - 1, int(b - a)


def _finders(docs: DataFrame, benchmark: DataFrame, threshold: float, block_bytes: int) -> Iterator[tuple[Items, list[Seeds]]]:
    for items in item_blocks(benchmark, block_bytes):
        yield items, choose_seeds(items, *word_counts(docs, items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, n_seeds: one row per document and leaked item.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes of whole texts. ``score`` is
    the best alignment as a share of a perfect copy's (1.0); several passages of an item in a
    document count by the best. Null and empty texts, and items without words, give no rows; rows
    with equal doc_ids are joined by the best score, null doc_ids are kept as one document. Without
    documents or items the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items, seeds in _finders(rows, benchmark, threshold, block_bytes):
        out = out.union(rows.mapInArrow(_leak_rows(items, seeds, threshold), schema))
    best = F.max(F.struct("score", "n_seeds", -F.col("first_word"), "last_word")).alias("__best")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("__best.score").alias("score"), (-F.col("__best.col3")).alias("first_word"), F.col("__best.last_word").alias("last_word"), F.col("__best.n_seeds").alias("n_seeds")
    )


def _leak_rows(items: Items, seeds: list[Seeds], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, seeds, threshold)
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = text_buffers(batch.column("text"))
            text, found = [], []
            for a, b in chunks(offsets):
                for d, k, *rest in finder.leaks(hash_words(data, offsets[a : b + 1], _ABC)):
                    text.append(a + d)
                    found.append((items.ids[k], *rest))
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all its columns, without the rows whose text holds a leaked item; texts never shuffle."""
    out = docs
    for items, seeds in _finders(docs, benchmark, threshold, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items, seeds=seeds) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, seeds, threshold)
            for batch in batches:
                data, offsets = text_buffers(batch.column("text"))
                clean = np.ones(batch.num_rows, bool)
                for a, b in chunks(offsets):
                    for leak in finder.leaks(hash_words(data, offsets[a : b + 1], _ABC)):
                        clean[a + leak[0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
