"""Removal of passages that an earlier document already has: a count-min prefilter, then exact groups.

A window is ``size`` consecutive words of one document. Pass one sketches all windows: every task
turns the windows of a segment (a run of rows of one input file) into sorted lists of the counters
they hit in each row of a count-min sketch; lists are grouped by block of counters and summed, a
counter rises once per document. The sum overestimates, so a window of two documents is never
missed. Each segment gets back those of its counters that reached two. Pass two hashes the windows
again and lets only those through whose counters all did; these are grouped exactly, by 96-bit
hashes, for the smallest doc_id. Pass three removes what they cover.

The sketch grows with the input (COUNTERS per window and row), no task ever holds more than one
block of it, and nothing of it is broadcast. Texts are never shuffled: segments are named by file
and row, and what is known about a segment waits in the shared folder, where whichever task
reads those rows finds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.session import forget

from .hashing import Members, alphabet, chunks, distinct, hash_words, text_buffers, window_hashes
from .segments import SEGMENT_ROWS, facts_of, folders, keep_facts, runs, segmented
from .tables import cut, fresh_dir, remove, small_batches

WINDOW = 50
#: Windows of a segment that are sketched at once; more come as further lists of that segment.
SEGMENT_WINDOWS = 2_000_000
#: Bytes of text that are hashed at once; a task's arrays take up to forty times as much.
CHUNK_BYTES = 1 << 19
#: Candidates of a segment that are held, sorted and sent at once.
SEGMENT_CANDIDATES = 500_000
SKETCH_ROWS, COUNTERS, BLOCK_BITS = 2, 4, 20
#: Bytes that one word takes at the least on average; only sizes the sketch.
WORD_BYTES = 6
_U = np.uint64
#: A counter and the place of a row in its segment share 64 bits.
_DOC_BITS = (SEGMENT_ROWS - 1).bit_length()
MAX_COUNTERS = 1 << (64 - _DOC_BITS)


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct integers: their low bytes, and the high parts as a bit string of steps.

    Takes about log2(mean gap) + 2 bits a value, rounded up to whole low bytes.
    """
    n = len(values)
    if not n:
        return b""
    gap = (int(values[-1]) + 1) / n
    width = 0 if gap < 8 else 1 if gap < 2048 else 2
    high = (values >> (8 * width)) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    low = (values & ((1 << 8 * width) - 1)).astype(f"<u{width}").tobytes() if width else b""
    return n.to_bytes(4, "little") + bytes([width]) + low + np.packbits(bits).tobytes()


def decode_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n, width = int.from_bytes(data[:4], "little"), data[4]
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=5 + n * width))) - np.arange(n)
    return (high << (8 * width)) + np.frombuffer(data, f"<u{width}", n, 5) if width else high


def _windows(part: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """Per chunk of rows: first row, words, text number and first word of its windows, their hashes."""
    data, offsets = text_buffers(part.column("text"))
    abc = alphabet()
    for a, b in chunks(offsets, CHUNK_BYTES):
        words = hash_words(data, offsets[a : b + 1], abc)
        text, at, hashes = window_hashes(words, size, 2)
        yield a, b, words, text, at, hashes


def _counters(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted counters of keys (counter and row), and which of them several rows hit; empties ``keys``."""
    key = np.concatenate(keys)
    keys.clear()
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]  # a row raises a counter once
    key >>= _U(_DOC_BITS)
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    first = new[:-1]
    return key[first].view(np.int64), ~new[1:][first]


def _sketch(size: int, width: int) -> Callable:
    """Tasks' lists of counters: seg, row and block of the sketch, counters hit once and more often."""

    def lists(seg: int, keys: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out = {"row": [], "block": [], "seg": [], "once": [], "more": []}
        for row in range(SKETCH_ROWS):
            slot, more = _counters(keys[row])
            blocks = distinct(slot >> BLOCK_BITS)[0]
            for block, a, b in zip(blocks, np.searchsorted(slot, blocks << BLOCK_BITS), np.searchsorted(slot, (blocks + 1) << BLOCK_BITS)):
                own, twice = slot[a:b] - (block << BLOCK_BITS), more[a:b]
                for key, value in (("row", row), ("block", int(block)), ("seg", seg), ("once", encode_sorted(own[~twice])), ("more", encode_sorted(own[twice]))):
                    out[key].append(value)
                if len(out["row"]) >= 256:
                    yield _lists_batch(out)
                    out = {k: [] for k in out}
        yield _lists_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held, n = None, [[] for _ in range(SKETCH_ROWS)], 0, 0
        for seg, part in runs(batches):
            if held and (seg != now or held > SEGMENT_WINDOWS):
                yield from lists(now, keys)
                held = 0
            if seg != now:
                now, n = seg, 0
            for a, _, _, text, _, hashes in _windows(part, size):
                if len(text):
                    doc = (text + (a + n)).astype(_U)
                    for row in range(SKETCH_ROWS):
                        key = hashes[row] % _U(width)
                        key <<= _U(_DOC_BITS)
                        key |= doc
                        keys[row].append(key)
                    held += len(text)
                if held > SEGMENT_WINDOWS:
                    yield from lists(now, keys)
                    held = 0
            n += part.num_rows
        if held:
            yield from lists(now, keys)

    return run


def _lists_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"row": pa.int32(), "block": pa.int64(), "seg": pa.int64(), "once": pa.binary(), "more": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))


def _merge(table: pa.Table) -> pa.Table:
    """One block of the merged sketch: each segment's counters that reached two."""
    counts = np.zeros(1 << BLOCK_BITS, np.int32)
    own: dict[int, list[np.ndarray]] = {}
    for seg, once, more in zip(table.column("seg").to_pylist(), table.column("once").to_pylist(), table.column("more").to_pylist()):
        one, two = decode_sorted(once), decode_sorted(more)
        counts[one] += 1
        counts[two] += 2
        own.setdefault(seg, []).extend((one, two))
    segs, hot = [], []
    for seg, found in own.items():
        at = distinct(np.concatenate(found))[0]
        at = at[counts[at] > 1]
        if len(at):
            segs.append(seg)
            hot.append(encode_sorted(at))
    n = len(segs)
    return pa.table({"row": pa.array([table.column("row")[0].as_py()] * n, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * n, pa.int64()), "seg": pa.array(segs, pa.int64()), "hot": pa.array(hot, pa.binary())})


def _hot_slots(directory: str, count: int, seg: int) -> list[Members]:
    table, members = facts_of(directory, count, seg), []
    for row in range(SKETCH_ROWS):
        lists = None if table is None else table.filter(pc.equal(table.column("row"), row)).sort_by("block")
        data = [] if lists is None else lists.column("hot").to_pylist()
        found, at = np.empty(sum(int.from_bytes(d[:4], "little") for d in data), _U), 0
        for block, hot in zip(lists.column("block").to_pylist() if data else [], data):
            part = decode_sorted(hot)
            found[at : at + len(part)] = part + (block << BLOCK_BITS)
            at += len(part)
        members.append(Members(found, ordered=True))
    return members


def _short(h: np.ndarray) -> np.ndarray:
    """The upper half of a hash, as Spark's int."""
    return (h >> _U(32)).astype(np.uint32).view(np.int32)


def _candidates(size: int, width: int, directory: str, count: int) -> Callable:
    """Distinct candidate windows of each segment, SEGMENT_CANDIDATES at a time: smallest doc_id, and whether there are several."""

    def rows(seg: int, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc = (np.concatenate([f[k] for f in found]) for k in range(3))
        found.clear()
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        new = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        last = np.r_[new[1:], len(h1)] - 1
        columns = [h1[new].view(np.int64), h2[new], np.full(len(new), seg), doc[new], doc[new] < doc[last]]
        del h1, h2, doc, order
        for a in range(0, len(new), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000]) for c in columns], ["h1", "h2", "seg", "low", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, found, held = None, [], [], 0
        for seg, part in runs(batches):
            if seg != now:
                if found:
                    yield from rows(now, found)
                members = []
                now, members, held = seg, _hot_slots(directory, count, seg), 0
            ids = part.column("doc_id")
            named = ~ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, _, _, text, _, hashes in _windows(part, size):
                keep = np.flatnonzero(named[text + a])
                for row, member in enumerate(members):
                    keep = keep[member.find(hashes[row][keep] % _U(width)) >= 0]
                if len(keep):
                    found.append((hashes[0][keep], _short(hashes[1][keep]), ids[text[keep] + a]))
                    held += len(keep)
                if held > SEGMENT_CANDIDATES:  # a window of several pieces has a row for each
                    yield from rows(now, found)
                    held = 0
        if found:
            yield from rows(now, found)

    return run


def _cover(size: int, directory: str, count: int, keep_text: bool) -> Callable:
    """The final pass: counts per document and what is left of it."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, member, table = None, None, None
        for seg, part in runs(batches):
            if seg != now:
                member = table = None  # what is known of the last segment goes first
                now, known = seg, facts_of(directory, count, seg)
                if known is None:
                    member = None
                else:
                    h1 = known.column("h1").to_numpy().view(_U)
                    order = np.argsort(h1, kind="stable")
                    h1 = h1[order]
                    new = np.ones(len(h1), bool)
                    np.not_equal(h1[1:], h1[:-1], out=new[1:])
                    member, order = Members(h1[new], ordered=True), order[new]
                    table = known.column("h2").to_numpy()[order], known.column("first").to_numpy()[order]
                    del known, h1, order
            ids = part.column("doc_id")
            named = ~ids.is_null().to_numpy(zero_copy_only=False)
            id_values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            raw = part.column("text").cast(pa.binary()).to_pylist()
            n_words, n_removed, left = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), []
            for a, b, words, text, at, hashes in _windows(part, size):
                n_words[a:b] = np.diff(words.first)
                gone = np.zeros(len(words.hashes) + 1, np.int64)
                if member is not None and len(text):
                    place = member.find(hashes[0])
                    hit = np.flatnonzero(place >= 0)
                    p, d = place[hit], text[hit] + a
                    hit = hit[(table[0][p] == _short(hashes[1][hit])) & (table[1][p] < id_values[d]) & named[d]]
                    np.add.at(gone, at[hit], 1)
                    np.subtract.at(gone, at[hit] + size, 1)
                gone = np.cumsum(gone[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                n_removed[a:b] = sums[words.first[1:]] - sums[words.first[:-1]]
                for k in range(a, b):
                    value = raw[k] or b""
                    mask = gone[words.first[k - a] : words.first[k - a + 1]]
                    if not n_removed[k]:
                        left.append(value if keep_text else hashlib.sha256(b" ".join(value.split())).hexdigest())
                    elif keep_text:
                        left.append(_without(value, words.start[words.first[k - a] : words.first[k - a + 1]], mask))
                    else:
                        left.append(hashlib.sha256(b" ".join([w for w, g in zip(value.split(), mask) if not g])).hexdigest())
            rest = [part.column(c) for c in part.schema.names if c not in ("text", "__seg")]
            names = [c for c in part.schema.names if c not in ("text", "__seg")]
            left = pa.array(left, pa.binary()).cast(pa.string()) if keep_text else pa.array(left, pa.string())
            if keep_text:  # a null text stays null
                left = pa.array([None if r is None else v for r, v in zip(raw, left.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words), pa.array(n_removed), left], [*names, "n_words", "n_removed", "left"])

    return run


def _without(value: bytes, start: np.ndarray, mask: np.ndarray) -> bytes:
    """``value`` without the masked words and the white space after them."""
    start = start - start[0] + (len(value) - len(value.lstrip()))
    ends = np.append(start[1:], len(value))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[0::2], edge[1::2]):
        out.append(value[at : start[a]])
        at = ends[b - 1]
    out.append(value[at:])
    return b"".join(out).rstrip() if mask[-1] else b"".join(out)


def remove_repeats(docs: DataFrame, size: int = WINDOW, keep_text: bool = False, counters: int | None = None) -> DataFrame:
    """Drop every word covered by a window whose words also start in a document of smaller doc_id.

    Words are runs without white space (0x20, 0x09-0x0D), compared unchanged; windows are judged
    on the input. Returns doc_id, n_words, n_removed and ``kept_sha256`` of the words left, joined by one
    space; with ``keep_text`` all columns of ``docs`` instead, ``text`` without the removed words, plus
    n_words and n_removed. A null or empty text has no words. Rows with a null doc_id neither
    lose words nor make others lose them; equal doc_ids do not affect each other. Every row
    comes back once, also from an empty table. ``counters`` is the least width of a row of the sketch,
    by default COUNTERS per window; it decides how many windows are grouped exactly, never the result.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in ("doc_id", "text")] if keep_text else []
    tag = {c: f"__x{k}" for k, c in enumerate(extra)}
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(t) for c, t in tag.items()]]
    rows = segmented(docs, columns).drop("__at")
    scan = rows.select("doc_id", "text", "__seg")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    blocks = 1 + ((counters or (total or 0) // WORD_BYTES * COUNTERS) >> BLOCK_BITS)
    width, count = int(blocks << BLOCK_BITS), folders(n_rows)
    if width > MAX_COUNTERS:
        raise ValueError(f"a sketch of {width} counters a row; a counter and a row of a segment fit 64 bits up to {MAX_COUNTERS}")
    lists = rows.select("text", "__seg").mapInArrow(_sketch(size, width), "row int, block long, seg long, once binary, more binary")
    hot = lists.groupBy("row", "block").applyInArrow(_merge, "row int, block long, seg long, hot binary")
    sketch_dir = fresh_dir(spark, "hot-counters")
    keep_facts(hot, sketch_dir, count)
    found = cut(scan.mapInArrow(_candidates(size, width, sketch_dir, count), "h1 long, h2 int, seg long, low long, several boolean"))
    remove(spark, sketch_dir)
    # One row per window and piece of a segment. The least doc_id is summed up before it is joined, so a window of all segments fills no task.
    firsts = found.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.max("low").alias("last"), F.max("several").alias("any"))
    firsts = firsts.where((F.col("first") < F.col("last")) | F.col("any")).select("h1", "h2", "first")
    earlier = found.join(firsts, ["h1", "h2"]).where((F.col("first") < F.col("low")) | F.col("several")).select("seg", "h1", "h2", "first")
    cover_dir = fresh_dir(spark, "repeats")
    keep_facts(earlier, cover_dir, count)
    forget(found)
    fields = [f for f in rows.schema.fields if f.name not in ("text", "__seg")]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("left", T.StringType())])
    out = rows.mapInArrow(_cover(size, cover_dir, count, keep_text), schema)
    if not keep_text:
        return out.select("doc_id", "n_words", "n_removed", F.col("left").alias("kept_sha256"))
    named = {"doc_id": F.col("doc_id"), "text": F.col("left"), **{c: F.col(t) for c, t in tag.items()}}
    return out.select(*[named[c].alias(c) for c in docs.columns], F.col("n_words").alias("__n_words"), F.col("n_removed").alias("__n_removed"))
