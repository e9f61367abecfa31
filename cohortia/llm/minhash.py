"""Near duplicates by MinHash with tensored banding, every link confirmed on full sets.

A text is its set of distinct word shingles. Two small collections of keys are made, each key
from a few MinHash values; every pair of a key of the first and a key of the second collection is
one table. ``M1`` x ``M2`` tables thus cost ``M1 * K1 + M2 * K2`` MinHash values instead of
``M1 * M2 * (K1 + K2)``. Two texts of similarity s share a table with probability
(1 - (1 - s**K1)**M1) * (1 - (1 - s**K2)**M2), 0.9993 at s = 0.8 and rising steeply.

Texts with equal sets are one node from the start. In every bucket each member is compared with two
hubs (the least under two hashed orders), so no pairs are formed inside a bucket. Links confirmed so
far join nodes to components. Where a bucket still holds several components, its members are
compared exactly, block against block of at most about BLOCK nodes, but never inside one component; only
links that join something new leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.session import forget

from .hashing import alphabet, chunks, hash_words, mix, text_buffers, window_hashes
from .tables import SMALL_BYTES, cut, small_batches

K1, M1, K2, M2 = 3, 11, 2, 8
N_HASHES = K1 * M1 + K2 * M2
#: Nodes, and bytes of their sets, that one side of an exact comparison holds.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Components from this size on have blocks of their own, which are never compared with each other.
LARGE = 128
HUB_STEPS = 3
_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * N_HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_XOR, _TIMES = _SEEDS[:N_HASHES], _SEEDS[N_HASHES:] | _U(1)


def _sets(column: pa.Array, size: int, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of texts: all sorted distinct shingle hashes in a row, and where each text's begin."""
    data, offsets = text_buffers(column)
    abc = alphabet(lower=lower)
    for a, b in chunks(offsets):
        words = hash_words(data, offsets[a : b + 1], abc)
        text, _, (hashes,) = window_hashes(words, size)
        counts = np.diff(words.first)
        # A text with fewer words than a shingle is one shingle: its whole sequence.
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            whole = np.zeros(len(short), _U)
            for k in range(size - 1):
                more = counts[short] > k
                whole[more] = mix(whole[more] * _U(0xD1342543DE82EF95) + words.hashes[words.first[short[more]] + k] + _U(1))
            text, hashes = np.concatenate([text, short]), np.concatenate([hashes, whole])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        yield hashes[new], np.searchsorted(text[new], np.arange(b - a + 1))


def _signatures(size: int, lower: bool):
    """doc_id, set size, a 128-bit key of the set, and the keys of both collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for hashes, first in _sets(batch.column("text"), size, lower):
                n = len(first) - 1
                count = np.diff(first)
                full = np.flatnonzero(count)
                keys = [np.zeros(n, _U) for _ in range(2 + M1 + M2)]
                if len(full):
                    starts = first[:-1][full]
                    keys[0][full] = np.add.reduceat(mix(hashes ^ _U(7)), starts)
                    keys[1][full] = np.add.reduceat(mix(hashes ^ _U(11)), starts)
                    least = [np.minimum.reduceat((hashes ^ x) * t, starts) for x, t in zip(_XOR, _TIMES)]
                    at = 0
                    for k, width in enumerate([K1] * M1 + [K2] * M2):
                        key = np.full(len(full), k + 1, _U)
                        for value in least[at : at + width]:
                            key = mix(key ^ value)
                        at += width
                        keys[2 + k][full] = key
                signed = [k.view(np.int64) for k in keys]
                pack = lambda cols: pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(cols) + 1, len(cols), dtype=np.int32)), pa.array(np.stack(cols, 1).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, n), pa.array(count.astype(np.int64)), pa.array(signed[0]), pa.array(signed[1]), pack(signed[2 : 2 + M1]), pack(signed[2 + M1 :])],
                    ["doc_id", "n", "k1", "k2", "first", "second"],
                )
                done += n

    return run


def _set_bytes(size: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for hashes, first in _sets(batch.column("text"), size, lower):
                n = len(first) - 1
                sets = [hashes[first[k] : first[k + 1]].tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, n), pa.array(sets, pa.binary())], ["node", "set"])
                done += n

    return run


def _confirm(percent: int):
    """Pairs with both sets: those whose intersection is large enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _held(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components, set sizes and all set members in a row, of one block."""
    at = column.offsets
    part = column.values.slice(at[row].as_py(), at[row + 1].as_py() - at[row].as_py())
    sets = part.field("set").to_pylist()
    flat = np.frombuffer(b"".join(sets), _U)
    return part.field("node").to_numpy(), part.field("comp").to_numpy(), np.array([len(x) // 8 for x in sets]), flat


def _new_links(percent: int, one: tuple, other: tuple | None) -> list[tuple[int, int]]:
    """Links between different components of one block, or of two, without those they imply."""
    node, comp, counts, members = one if other is None else tuple(np.concatenate(x) for x in zip(one, other))
    first = len(one[0])
    starts = np.cumsum(counts) - counts
    _, flat = np.unique(members, return_inverse=True)
    root = {c: c for c in comp.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    seen = np.zeros(int(flat.max()) + 1, np.int32)
    links = []
    for i in range(first):
        own = flat[starts[i] : starts[i] + counts[i]]
        seen[own] = 1
        both = np.add.reduceat(seen[flat], starts)
        seen[own] = 0
        close = 100 * both >= percent * (counts + counts[i] - both)
        close[: i + 1 if other is None else first] = False
        for j in np.flatnonzero(close):
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x != y:
                root[x] = y
                links.append((int(node[i]), int(node[j])))
    return links


def _compare_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for k in range(batch.num_rows):
                alone = not batch.column("held_b")[k].is_valid
                links += _new_links(percent, _held(batch.column("held_a"), k), None if alone else _held(batch.column("held_b"), k))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and comp (least reachable node) of every node of ``links(a, b)``.

    Each round a node takes the least label among its own and its neighbours', then the label of its label;
    rounds grow with the logarithm of the longest chain and each is written to the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    made = state = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    while True:
        near = both.join(state, both.b == state.node).groupBy("a").agg(F.min("comp").alias("near"))
        new = state.join(near, state.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = new.select(F.col("node").alias("at"), F.col("comp").alias("beyond"))
        new = cut(new.join(jump, F.col("comp") == F.col("at")).select("node", "was", F.least("comp", "beyond").alias("comp")))
        moved = new.where("comp <> was").limit(1).count()
        last, state, made = made, new.select("node", "comp"), new
        if not moved:
            return state
        forget(last)


def _order(which: int) -> Column:
    return F.struct(F.xxhash64(F.lit(which), F.col("node")).alias("order"), F.col("node"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept, per document.

    Words are runs without white space (0x20, 0x09-0x0D), with A-Z in lower case if ``lower``. Two
    documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets. A
    document with fewer words than a shingle has its whole sequence as the only one; one without
    words, also a null text, has the empty set and is linked with nothing. Rows with a null
    doc_id come back as components of their own (component_id null, kept true). Rows of equal
    doc_id are different texts under one name: a link of either is a link of the id. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_signatures(size, lower), "doc_id long, n long, k1 long, k2 long, first array<long>, second array<long>"))
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = cut(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")))
    same = ["k1", "k2"]
    # The row that speaks for a set; rows with equal sets have equal keys, so any would do.
    rep = named.join(nodes, same).where(F.col("doc_id") == F.col("node")).dropDuplicates(["node", "k1", "k2"])
    keyed = rep.select("node", "n", F.explode("first").alias("__x"), "second").select("node", "n", "__x", F.explode("second").alias("__y"))
    rows = keyed.select(F.xxhash64("__x", "__y").alias("key"), "node", F.col("n").cast("int").alias("n"))
    hubs = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(_order(1)).alias("h1"), F.min(_order(2)).alias("h2")).where("members > 1")
    shared = cut(rows.join(hubs.select("key", "members", F.col("h1.node").alias("h1"), F.col("h2.node").alias("h2")), "key"))
    # Every bucket member against both hubs; what is too different in size cannot be linked.
    pairs = shared.select("node", F.explode(F.array("h1", "h2")).alias("hub")).where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    wanted = cut(shared.select("node").distinct())
    count = wanted.count()
    small = F.broadcast(wanted) if count * 16 <= SMALL_BYTES else wanted
    chosen = texts.join(small, texts.doc_id == small.node, "left_semi")
    sets = cut(chosen.mapInArrow(_set_bytes(size, lower), "node long, set binary"))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"), F.length("set").alias("n_a")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"), F.length("set").alias("n_b")), "b")
    full = full.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    links = cut(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"))
    comp = components(spark, links)
    more = cut(_cross_links(shared, sets, comp, percent))
    # Copies of one text may go by several ids, and one id by several texts.
    tied = named.join(nodes, same).where(F.col("doc_id") != F.col("node")).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    if more.limit(1).count() or _ids_repeat(named):
        comp = components(spark, links.union(more) if not _ids_repeat(named) else links.union(more).union(tied))
    for done in (shared, wanted, sets, links, more):  # all that follows reads comp, signed and nodes
        forget(done)
    own = named.join(nodes, same).select("doc_id", "node").groupBy("doc_id").agg(F.min("node").alias("node"))
    final = own.join(comp, "node", "left").select(F.col("doc_id").alias("__doc"), F.coalesce("comp", "node").alias("__comp"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("__doc"), "left")
    comp_id = F.coalesce("__comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(comp_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def _ids_repeat(named: DataFrame) -> bool:
    return named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b").limit(1).count() > 0


def _cross_links(shared: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components so far.

    In a bucket of two, or of three with two hubs, every pair has been compared. Nodes are dealt to
    blocks: those of a large component among themselves, the others with the neighbours they share
    a hub with, directly or through other hubs. Pairs of blocks that meet in a bucket of several components are compared once,
    however many buckets they meet in.
    """
    comp = comp.select(F.col("node").alias("__n"), "comp")
    nodes = cut(shared.groupBy("node").agg(F.min(F.least("h1", "h2")).alias("hub"), F.first("n").alias("n")))
    for _ in range(HUB_STEPS):  # towards one hub for all that hang together; how far only decides who shares a block
        up = nodes.select(F.col("node").alias("__u"), F.col("hub").alias("__hub"))
        nodes = nodes.join(up, F.col("hub") == F.col("__u"), "left").select("node", F.least("hub", "__hub").alias("hub"), "n")
    nodes = nodes.join(comp, F.col("node") == F.col("__n"), "left").select("node", "hub", F.coalesce("comp", "node").alias("comp"), "n")
    large = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LARGE).select(F.col("comp").alias("__c"), "size")
    nodes = nodes.join(large, F.col("comp") == F.col("__c"), "left")
    nodes = nodes.withColumn("home", F.when(F.col("size").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("comp").alias("of"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("hub").alias("of"))))
    homes = nodes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("parts")).select(F.col("home").alias("__h"), "parts")
    nodes = nodes.join(homes, F.col("home") == F.col("__h"))
    part = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts"))
    block = F.xxhash64("home.kind", "home.of", part)
    whole = F.when(F.col("home.kind") == 0, F.col("comp"))
    nodes = cut(nodes.select("node", "comp", block.alias("block"), whole.alias("whole")))
    compared = (F.col("members") == 2) | ((F.col("members") == 3) & (F.col("h1") != F.col("h2")))
    placed = shared.where(~compared).select("key", "node").join(nodes, "node")
    met = placed.groupBy("key", "block", "whole").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    several = met.groupBy("key").agg(F.min("low").alias("__low"), F.max("high").alias("__high")).where("__low <> __high").select("key")
    met = cut(met.join(several, "key", "left_semi").select("key", "block", "whole"))
    other = met.select(F.col("key").alias("__k"), F.col("block").alias("block_b"), F.col("whole").alias("whole_b"))
    meetings = met.join(other, (F.col("key") == F.col("__k")) & (F.col("block") <= F.col("block_b")))
    meetings = meetings.where(~F.coalesce(F.col("whole") == F.col("whole_b"), F.lit(False)))
    meetings = meetings.select(F.col("block").alias("block_a"), "block_b").distinct()
    held = nodes.join(sets, "node").groupBy("block").agg(F.collect_list(F.struct("node", "comp", "set")).alias("held"))  # bounded by the parts above
    left, right = (held.select(F.col("block").alias(b), F.col("held").alias(h)) for b, h in (("block_a", "held_a"), ("block_b", "held_b")))
    both = meetings.join(left, "block_a").join(right, "block_b").select("held_a", F.when(F.col("block_a") != F.col("block_b"), F.col("held_b")).alias("held_b"))
    return both.mapInArrow(_compare_blocks(percent), "a long, b long")
