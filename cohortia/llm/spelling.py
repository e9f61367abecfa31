"""Spelling variants of a corpus: the vocabulary composed with one edit and with itself.

All pairs of words that differ by one inserted, deleted or replaced code point are the pairs that
the machine A o E o A accepts, where A is the minimal acceptor of the vocabulary and E a transducer
of exactly one edit. While nothing is edited yet, both copies of A have read the same letters, so
the machine falls apart by the place of the edit: a partition is named by what both words share
beyond a window of places, and its initial state is the one A is in after the shared beginning. Each
partition builds its own part of A, minimised, and enumerates what the composition accepts there.

With s the length of the shorter word, places 0 .. s are split into two windows at first. Words
that share their first half form a partition of the right window, words that share the rest one of
the left. A partition of more than PARTITION_WORDS words is split again, each half of its window
naming more of the words, until a window is one place wide; then a partition holds no more words
than there are pairs of letters. So every pair is found exactly once, no partition grows with the
corpus, and each word takes part in four partitions, in more only where words crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import forget

from .tables import SMALL_BYTES, cut

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One word in so many loses a code point before it is counted, by the checksum of its document and itself.
DELETE_EVERY = 31
#: Words that one acceptor holds, and rows that one task reads.
PARTITION_WORDS, TASK_ROWS = 10_000, 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int | None = DELETE_EVERY) -> DataFrame:
    """word and n: maximal runs of letters of whole texts, A-Z lower-cased, that occur ``min_count`` times.

    With ``delete_every`` a run loses the code point h % length wherever that number divides h, the CRC-32 of
    "<doc_id>:<run>"; a null doc_id is written as nothing.
    """
    # A shorter run stays too short when it loses a letter.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("raw"))
    word = F.col("raw")
    word = F.when(word == F.lower(word), word).otherwise(F.translate(word, UPPER, UPPER.lower()))
    words = runs.select("doc_id", word.alias("word"))
    if delete_every:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
        words = words.select("word", F.crc32(name.cast("binary")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        without = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % delete_every == 0, without).otherwise(F.col("word")).alias("word"))
    words = words.where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """A minimal acyclic acceptor of several word sets; each set has an initial state of its own.

    States with the same right language are one state, also across the sets.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._register: dict[tuple, int] = {}
        self._meets: dict[tuple[int, int], bool] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        known = self._register.get(key)
        if known is None:
            known = self._register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return known

    def add(self, words: list[str]) -> int:
        """The initial state of ``words``, which ascend and are distinct."""
        path: list[list] = [[False, {}]]  # the states of the last word's letters that may still get arcs
        last = ""
        for word in words:
            shared = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                shared += 1
            while len(path) > shared + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(final, arcs)
            path += [[False, {}] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            final, arcs = path.pop()
            path[-1][1][last[len(path) - 1]] = self._state(final, arcs)
        return self._state(*path[0])

    def meets(self, p: int, q: int) -> bool:
        """Do the right languages of two states share a word?"""
        if p == q:
            return True
        known, arcs, final = self._meets, self.arcs, self.final
        if (p, q) in known:
            return known[p, q]
        stack = [(p, q, False)]
        while stack:
            a, b, seen = stack.pop()
            if (a, b) in known:
                continue
            if final[a] and final[b]:
                known[a, b] = True
                continue
            below = [(arcs[a][c], arcs[b][c]) for c in arcs[a].keys() & arcs[b].keys()]
            if any(x == y or known.get((x, y)) for x, y in below):
                known[a, b] = True
            elif seen or not below:
                known[a, b] = False
            else:
                stack.append((a, b, True))
                stack += [(x, y, False) for x, y in below]
        return known[p, q]

    def common(self, p: int, q: int) -> Iterator[str]:
        """The words of both right languages."""
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            a, b, depth, letter = stack.pop()
            del path[depth:]
            path.append(letter)
            if self.final[a] and self.final[b]:
                yield "".join(path)
            for c in self.arcs[a].keys() & self.arcs[b].keys():
                if self.meets(self.arcs[a][c], self.arcs[b][c]):
                    stack.append((self.arcs[a][c], self.arcs[b][c], depth + 1, c))

    def replaced(self, words: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs of one word set whose edit replaces a letter, the smaller word first."""
        arcs = self.arcs
        stack = [(words, "")]
        while stack:
            p, read = stack.pop()
            letters = sorted(arcs[p])
            for k, c in enumerate(letters):
                stack.append((arcs[p][c], read + c))
                for d in letters[k + 1 :]:
                    if self.meets(arcs[p][c], arcs[p][d]):
                        for rest in self.common(arcs[p][c], arcs[p][d]):
                            yield read + c + rest, read + d + rest

    def inserted(self, short: int, long: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """Accepted pairs of two word sets whose edit inserts a letter, after the last one only with ``at_end``.

        The letter differs from the next one, so the edit is where the two words first differ and a pair comes once.
        """
        arcs = self.arcs
        stack = [(short, long, "")]
        while stack:
            p, q, read = stack.pop()
            for c in arcs[p].keys() & arcs[q].keys():
                stack.append((arcs[p][c], arcs[q][c], read + c))
            for d, below in arcs[q].items():
                if self.meets(p, below):
                    for rest in self.common(p, below):
                        if rest[:1] != d and (rest or at_end):
                            yield read + rest, read + d + rest


PAIR = "a string, n_a long, b string, n_b long"


def _pairs_of(words: list[str], counts: list[int], s: int, lo: int, hi: int) -> Iterator[tuple[str, int, str, int]]:
    """Near words of one partition: words of length s and s + 1 that agree before place lo and after place hi."""
    tail = max(0, s - hi)
    middle = {w[lo : len(w) - tail]: k for k, w in enumerate(words)}
    width = s - tail - lo
    short, long = sorted(m for m in middle if len(m) == width), sorted(m for m in middle if len(m) > width)
    if not short or len(middle) < 2:
        return
    part = Acceptor()
    start = part.add(short)
    found = [part.replaced(start)] if len(short) > 1 else []
    if long:
        found.append(part.inserted(start, part.add(long), hi > s))
    for pairs in found:
        for x, y in pairs:
            i, j = middle[x], middle[y]
            yield words[i], counts[i], words[j], counts[j]


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every partition; a partition's rows follow each other."""
    key, words, counts, out = None, [], [], []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], ["a", "n_a", "b", "n_b"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("s", "lo", "hi", "fixed", "word", "n")))
        for s, lo, hi, fixed, word, n in rows:
            if key != (s, lo, hi, fixed):
                if len(words) > 1:
                    out += _pairs_of(words, counts, *key[:3])
                    if len(out) > 10_000:
                        yield packed()
                        out = []
                key, words, counts = (s, lo, hi, fixed), [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        out += _pairs_of(words, counts, *key[:3])
    yield packed()


def _windows(frontier: DataFrame, halves: Column) -> DataFrame:
    """Each word once per window (s, lo, hi), with what the window leaves fixed and a hash that names the partition."""
    rows = frontier.select("word", "n", F.explode(halves).alias("w")).select("word", "n", "w.*")
    tail = F.greatest(F.lit(0), F.col("s") - F.col("hi"))
    fixed = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - tail + 1, tail))
    return rows.withColumn("fixed", fixed).withColumn("part", F.xxhash64("s", "lo", "hi", "fixed"))


def near_pairs(vocabulary: DataFrame, min_length: int = MIN_LENGTH, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """a, n_a, b, n_b: every unordered pair of words that differ by exactly one edit, once.

    ``vocabulary`` has distinct words of at least ``min_length`` code points and their counts n. Where both have one
    length a < b, else a is the shorter.
    """
    spark = vocabulary.sparkSession
    window = lambda s, lo, hi: F.struct(s.alias("s"), lo.alias("lo"), hi.alias("hi"))
    split = lambda s, lo, hi, mid: [window(s, lo, mid), window(s, mid, hi)]
    size = F.length("word")
    own = split(size, F.lit(0), size + 1, F.floor(size / 2).cast("int"))
    less = split(size - 1, F.lit(0), size, F.floor((size - 1) / 2).cast("int"))
    halves = F.when(size > min_length, F.array(*own, *less)).otherwise(F.array(*own))
    frontier, found = cut(_windows(vocabulary, halves)), []
    while True:
        # A partition one place wide holds a beginning, an end and at most two letters between: bounded by the alphabet.
        large = frontier.where("hi - lo > 1").groupBy("part").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > partition_words).select("part")
        large = cut(large)
        crowded = large.count()
        sent = F.broadcast(large) if crowded * 16 <= SMALL_BYTES else large
        ready = frontier.join(sent, "part", "left_anti") if crowded else frontier
        tasks = 1 + frontier.count() // TASK_ROWS
        dealt = ready.repartition(tasks, "part").sortWithinPartitions("part", "s", "lo", "hi", "fixed")
        found.append(cut(dealt.select("s", "lo", "hi", "fixed", "word", "n").mapInArrow(_enumerate, PAIR)))
        if not crowded:
            forget(frontier)
            break
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        narrower = F.array(*split(F.col("s"), F.col("lo"), F.col("hi"), mid))
        # Two partitions of one hash count as one and are split early, which is harmless.
        again = frontier.join(sent, "part", "left_semi").where("hi - lo > 1")
        kept = frontier.join(sent, "part", "left_semi").where("hi - lo = 1")
        after = _windows(again, narrower).unionByName(kept) if crowded else again
        after = cut(after)
        forget(frontier)
        forget(large)
        frontier = after
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: where following ``form`` ends, by doubling the steps of every word each round.

    Counts grow tenfold along a step, so no way is longer than 19 steps and five rounds suffice.
    """
    reach = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("on")))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = cut(reach.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("on")))
        forget(reach)
        reach = after
        if not reach.where("on").limit(1).count():
            return reach.drop("on")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int | None = DELETE_EVERY) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary (see ``count_words``).

    A word's form is its near word of largest count (of equal ones the smallest in code-point order) if that is at
    least ``ratio`` times its own, else null; its root is where following forms ends. Words without near words have
    n_near 0. Null and empty texts have no words, a null doc_id is written as nothing in the checksum, repeated rows count again, whole texts
    are read however long they or their words are, other columns are not looked at, and an empty table gives an empty result.
    """
    vocabulary = cut(count_words(docs, min_length, min_count, delete_every))
    pairs = near_pairs(vocabulary, min_length)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.select(F.explode(both).alias("r")).select("r.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    judged = cut(judged)
    forget(vocabulary)
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
