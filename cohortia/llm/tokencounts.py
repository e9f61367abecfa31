"""Token counts through a cache: a text is encoded once per tokenizer version, ever.

Every text is named by the SHA-256 of its normal form, and every tokenizer by the SHA-256 of its
file, its library's version and the rules of counting. The cache is a folder of Parquet files per
tokenizer version with one row per digest. A call joins the distinct digests of its texts to the
cache, encodes one text of each digest that is missing where it lies, appends the counts, and
joins all rows to them. Only digests, places and counts are shuffled; texts never are.

The normal form must not change a count. It is the text itself (a null is empty); where the
tokenizer has a normaliser of its own, it is what that makes of the text, unless the text spells
out an added token, which the library looks for before it normalises.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.session import forget

from .segments import facts_of, folders, keep_facts, runs, segmented
from .tables import cut, exists, fresh_dir, remove, small_batches, texts

#: Digests that hold more than one row in so many are joined apart; there can be no more of them than this.
HOT_SHARE = 1000
#: Bytes of text that go to the library in one call.
CALL_BYTES = 1 << 20
STORED = "digest binary, n_tokens long"


class Counter(NamedTuple):
    """A tokenizer as the tasks need it: its file, its library, and the digest of all that decides a count."""

    data: bytes
    kind: str
    version: str


def load_counter(path: str) -> Counter:
    """A vocabulary file for the tokenizers library (.json) or the sentencepiece library (.model)."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    library = __import__(kind)
    with open(path, "rb") as f:
        data = f.read()
    rules = f"{kind} {library.__version__}; no begin, end or added special tokens, no truncation, no padding;"
    return Counter(data, kind, hashlib.sha256(rules.encode() + data).hexdigest())


class _Library:
    """The worker's instance of a tokenizer."""

    def __init__(self, counter: Counter):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if counter.kind == "sentencepiece":
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=counter.data)
            self.tokenizer, self.normaliser, self.added = None, None, []
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(counter.data.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.normaliser = self.tokenizer.normalizer
            self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def counts(self, part: list[str]) -> list[int]:
        if self.tokenizer is None:
            return [len(ids) for ids in self.pieces.encode(part, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def digest(self, text: str) -> bytes:
        """Of the normal form; texts with an added token are kept apart from all normalised ones."""
        if any(a in text for a in self.added):
            return hashlib.sha256(b"as it is:" + text.encode()).digest()
        return hashlib.sha256(b"normalised:" + self.normaliser.normalize_str(text).encode()).digest()


_LIBRARIES: dict[str, _Library] = {}


def _library(counter: Counter) -> _Library:
    if counter.version not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[counter.version] = _Library(counter)
    return _LIBRARIES[counter.version]


def _with_digests(rows: DataFrame, counter: Counter) -> DataFrame:
    """doc_id, n_bytes, digest, __seg and __at of ``rows``; in the JVM unless the tokenizer normalises."""
    text = F.coalesce("text", F.lit(""))
    narrow = [F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")]
    if _Library(counter).normaliser is None:
        return rows.select(*narrow, F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), "__seg", "__at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(counter)
        for batch in batches:
            digests = pa.array([library.digest(t) for t in texts(batch.column("text"))], pa.binary())
            names = ["doc_id", "n_bytes", "__seg", "__at"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], digests], [*names, "digest"])

    given = rows.select(*narrow, "__seg", "__at", text.cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, __seg long, __at int, digest binary")


def _encode(counter: Counter, directory: str, count: int):
    """Counts of the rows that the facts in ``directory`` name, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(counter)
        now, places, digests = None, None, None
        for seg, part in runs(batches):
            if seg != now:
                now, known = seg, facts_of(directory, count, seg)
                if known is not None:
                    known = known.sort_by("at")
                    digests = known.column("digest").combine_chunks()
                places = None if known is None else known.column("at").to_numpy()
            if places is None:
                continue
            at = part.column("__at").to_numpy()
            mine = np.flatnonzero((at[0] <= places) & (places <= at[-1]))
            if not len(mine):
                continue
            wanted = texts(part.column("text").take(pa.array(np.searchsorted(at, places[mine]))))
            n_tokens, a, held = [], 0, 0
            for b, text in enumerate(wanted, 1):
                held += len(text)
                if held >= CALL_BYTES or b == len(wanted):
                    n_tokens += library.counts(wanted[a:b])
                    a, held = b, 0
            yield pa.RecordBatch.from_arrays([digests.take(pa.array(mine)), pa.array(n_tokens, pa.int64())], ["digest", "n_tokens"])

    return run


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens of every text the cache knows for a tokenizer version; each digest once."""
    path = f"{cache}/version={version}"
    if not exists(spark, path):
        return spark.createDataFrame([], STORED)
    # Two calls at the same time may append a digest each; their counts are equal.
    return spark.read.schema(STORED).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``, and its digest.

    ``tokenizer`` is the path of a vocabulary file. ``cache`` is a folder every executor reaches
    that outlives the call; without it the call starts from an empty one of its own. Whole texts are
    counted as the library does by default: special strings inside a text count as its tokens. A null or empty text has 0 tokens.
    Repeated rows, repeated or null doc_ids each come back once; an empty table gives an empty
    result; other columns are left out, so their names cannot clash. Bytes that are no UTF-8 count as U+FFFD.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counter = load_counter(tokenizer)
    kept = cache.rstrip("/") if cache else fresh_dir(spark, "token-counts")
    rows = segmented(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])
    keys = cut(_with_digests(rows, counter))
    total = keys.count()
    distinct = cut(keys.groupBy("digest").agg(F.min(F.struct("__seg", "__at")).alias("first"), F.count(F.lit(1)).alias("n")))
    missing = distinct.join(stored_counts(spark, kept, counter.version), "digest", "left_anti")
    directory, count = fresh_dir(spark, "misses"), folders(total)
    keep_facts(missing.select(F.col("first.__seg").alias("seg"), F.col("first.__at").alias("at"), "digest"), directory, count)
    texts_ = rows.select("__seg", "__at", F.col("text").cast("binary").alias("text"))
    texts_.mapInArrow(_encode(counter, directory, count), STORED).write.mode("append").parquet(f"{kept}/version={counter.version}")
    remove(spark, directory)
    known = stored_counts(spark, kept, counter.version)
    # A digest of more than a thousandth of the rows would fill one task of the join: fewer than a thousand such, sent to all.
    frequent = F.col("n") * HOT_SHARE > total
    hot = cut(distinct.where(frequent).select("digest").join(known, "digest"))
    forget(distinct)
    apart = keys.join(F.broadcast(hot), "digest")
    others = keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known, "digest", "left")
    columns = ["doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest"]
    return apart.select(*columns).unionByName(others.select(*columns))
