"""Token ids in files of fixed-width bit fields.

Layout of a file: the magic, the packed blocks, then a footer of arrays and a JSON head that
tells their lengths, then the length of that head and the magic again. Each id takes ``bits``
bits, the least that hold every id of the vocabulary; a block holds BLOCK_IDS ids (the last
fewer) and starts at a byte offset kept in the footer, so id k lies in block k // BLOCK_IDS and
any range of ids is unpacked by numpy without reading what lies before it.

Documents are dealt to files by ranges of doc_id of about equal bytes: only the raw texts are
shuffled, once, and each task tokenises, packs and writes its own file under a name of its own
before renaming it, so a task that is run again simply writes its file again.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import chunks, text_buffers
from .tables import filesystem, fresh_dir, small_batches

MAGIC = b"IDBITS01"
BLOCK_IDS = 1 << 15
#: Bytes of text that go to one file, and what a document counts at least.
FILE_BYTES, UNIT_BYTES = 24 << 20, 1 << 16
#: So many files at most, larger ones then: their manifest and cuts reach the driver.
MAX_FILES = 50_000
#: Bytes of text that are encoded in one call.
CALL_BYTES = 8 << 20
#: Words that a worker remembers, and the longest of them.
MEMORY, LONGEST = 700_000, 48


def id_bits(vocabulary: int) -> int:
    """The least number of bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as consecutive little-endian fields of ``bits`` bits."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` fields of a packed block as uint32."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
    return (flat @ weights).astype(np.uint32)


class Writer:
    """Streams documents into one file; memory holds a few blocks of ids and some numbers a document."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.ids, self.held = [], 0
        self.doc_ids, self.sizes = [], []
        self.offsets, self.n_ids = [len(MAGIC)], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray, end_id: int | None = None) -> None:
        """One more document; ``end_id`` is appended to its ids if given."""
        parts = [ids] if end_id is None else [ids, np.array([end_id], ids.dtype)]
        self.doc_ids.append(doc_id)
        self.sizes.append(sum(map(len, parts)))
        self.ids += parts
        self.held += self.sizes[-1]
        if self.held >= 8 * BLOCK_IDS:
            self._flush(self.held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, count: int) -> None:
        held = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        for a in range(0, count, BLOCK_IDS):
            block = pack(held[a : min(a + BLOCK_IDS, count)], self.bits)
            self.out.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
        self.ids, self.held, self.n_ids = [held[count:]], len(held) - count, self.n_ids + count

    def close(self) -> dict:
        self._flush(self.held)
        known = np.array([d is not None for d in self.doc_ids], bool)
        arrays = {
            "offsets": np.array(self.offsets, "<i8"),
            "doc_ids": np.array([d or 0 for d in self.doc_ids], "<i8"),
            "has_id": known.astype("<u1"),
            "sizes": np.array(self.sizes, "<i8"),
        }
        head = {"bits": self.bits, "block_ids": BLOCK_IDS, "n_docs": len(self.sizes), "n_ids": self.n_ids, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}
        for v in arrays.values():
            self.out.write(v.tobytes())
        text = json.dumps(head).encode()
        self.out.write(text + len(text).to_bytes(8, "little") + MAGIC)
        return head


class Reader:
    """Random access to the ids of one file; reads the footer and then only the blocks asked for."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - 16)
        tail = source.read(16)
        source.seek(0)
        if tail[8:] != MAGIC or source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a whole file of packed ids")
        size = int.from_bytes(tail[:8], "little")
        source.seek(end - 16 - size)
        self.head = json.loads(source.read(size))
        at = end - 16 - size - sum(np.dtype(t).itemsize * n for _, t, n in self.head["arrays"])
        source.seek(at)
        for name, kind, n in self.head["arrays"]:
            setattr(self, name, np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind))
        self.starts = np.zeros(len(self.sizes) + 1, np.int64)
        np.cumsum(self.sizes, out=self.starts[1:])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        bits, per = self.head["bits"], self.head["block_ids"]
        a, b = start // per, (stop - 1) // per + 1
        self.source.seek(int(self.offsets[a]))
        data = self.source.read(int(self.offsets[b] - self.offsets[a]))
        out = []
        for k in range(a, b):
            count = min(per, self.head["n_ids"] - k * per)
            out.append(unpack(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], bits, count))
        return np.concatenate(out)[start - a * per : stop - a * per]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class WordEncoder:
    """Encodes each white-space separated string once while it is remembered, many in one call.

    Arrow splits the texts and numbers their distinct strings, so Python sees each string once per
    call and numpy lays the ids out. Valid for tokenizers whose pre-tokenizer drops white space and
    keeps runs of letters apart from punctuation; ``load_tokenizer`` proves that on the loaded file's
    settings. So a space may be put between a letter and the punctuation after it, and ASCII letters
    may be lowered first where the tokenizer lowers them anyway. Unseen strings are encoded
    in a row with a NUL between them, whose id marks where each ends.
    """

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        spec = json.loads(description)
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        mark = self._ids("\0")
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _encode(self, words: list[str]) -> list[bytes]:
        out, width = [], self.kind.itemsize
        for a in range(0, len(words), 200):
            part = words[a : a + 200]
            text = " \0 ".join(part)
            if self.mark is None or text.count("\0") != len(part) - 1:
                out += [self._ids(w).tobytes() for w in part]
                continue
            ids = self._ids(text)
            marks = np.flatnonzero(ids == self.mark) * width
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip([0, *(marks + width).tolist()], [*marks.tolist(), len(data)])]
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct strings, as bytes."""
        if len(self.memory) > MEMORY:  # what was not used since the last turn is forgotten
            self.older, self.memory = self.memory, {}
        memory, older, new = self.memory, self.older, []
        out = list(map(memory.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            word = words[k]
            ids = older.get(word)
            if ids is None:
                new.append(k)
            else:
                out[k] = memory[word] = ids
        for k, ids in zip(new, self._encode([words[k] for k in new])):
            out[k] = ids
            if len(words[k]) <= LONGEST:
                memory[words[k]] = ids
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column's texts in a row, and where each text's begin (one more at the end)."""
        if self.lowers:
            low = pc.ascii_lower(column)
            # Special strings only count as they are written; what lowering might make one stays.
            column = pc.if_else(pc.match_substring_regex(low, self.special.lower()), column, low) if self.special else low
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(column, "([A-Za-z])([.,!?;:#$%&*)])", "\\1 \\2"))
        flat = words.flatten().dictionary_encode()
        collecting = gc.isenabled()
        gc.disable()  # the memory is large and holds no cycles
        try:
            known = self._known(flat.dictionary.to_pylist())
        finally:
            if collecting:
                gc.enable()
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        data = np.frombuffer(b"".join(known), self.kind)
        index = flat.indices.to_numpy(zero_copy_only=False)
        each = size[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        begin = (np.cumsum(size) - size)[index] if len(index) else each
        ids = data[np.repeat(begin - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        at = words.offsets.to_numpy() - words.offsets[0].as_py() if len(words) else np.zeros(1, np.int64)
        return ids, np.concatenate([[0], ends])[at]


def load_tokenizer(path: str) -> tuple[str, int]:
    """The description of a tokenizer file and the size of its id space; read on the driver.

    Refused unless white space is dropped before merging and no added token holds any, since
    only then the ids of a text are those of its white-space separated strings in a row.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        description = f.read()
    spec = json.loads(description)
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    split = next((s for s in steps if s["type"] == "Split"), None)
    parts = split["pattern"].get("Regex", "").split("|") if split else []
    drops = bool(parts) and split["behavior"] == "Removed" and split["invert"] and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(parts)
    drops = drops and all(p.startswith("'") or p.startswith("[") for p in parts)
    prefix = any(s.get("add_prefix_space") for s in steps)
    strips = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    if not drops or prefix or strips or spec.get("truncation") or spec.get("padding"):
        raise ValueError("only tokenizers that part words from white space and punctuation before merging can be used")
    tokenizer = Tokenizer.from_str(description)
    return description, max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(description: str) -> WordEncoder:
    key = hash(description)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(description)
    return _ENCODERS[key]


def _range_of(values: Column, cuts: list[int]) -> Column:
    """Number of the range between the ascending ``cuts`` that holds a value; a null is in the first."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64)).astype(np.int32))

    lowest = F.lit(cuts[0] if cuts else 0).cast("long")
    return place(F.coalesce(values, lowest)) if cuts else F.lit(0)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, directory: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenise whole texts and write them, in ascending doc_id order, as packed files.

    Returns the manifest, one row per file: path, first_id (ids in all files before it), n_ids,
    n_docs. ``end_id`` ends every document; a null or empty text has it alone. Equal doc_ids
    follow each other in the order of their texts, null doc_ids come first. Of the other columns
    nothing is kept. An empty table gives no file. The cuts are weighted quantiles of
    doc_id; only one number per file reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    description, vocabulary = load_tokenizer(tokenizer)
    bits = id_bits(max(vocabulary, end_id + 1))
    directory = directory or fresh_dir(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total, n = rows.agg(F.sum(size.cast("long")), F.count(F.lit(1))).first()
    files = 1 + int((total or 0) // max(file_bytes, (total or 0) // MAX_FILES + 1))
    cuts: list[int] = []
    if files > 1:
        # A long text stands for as many rows as it has units of bytes, so that the ranges hold equal bytes.
        weighted = rows.select("doc_id", F.explode(F.sequence(F.lit(0), (size / UNIT_BYTES).cast("int"))).alias("__unit")).where(F.col("doc_id").isNotNull())
        got = weighted.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], max(1000, 20 * files))).first()[0]
        cuts = sorted(set(got or []))
    dealt = rows.withColumn("__file", _range_of(F.col("doc_id"), cuts))
    dealt = dealt.repartitionById(len(cuts) + 1, "__file").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, writer = _encoder(description), None, None
        for batch in batches:
            column = batch.column("text").fill_null("")
            _, offsets = text_buffers(column)
            for a, b in chunks(offsets, CALL_BYTES):
                if writer is None:
                    number = batch.column("file")[0].as_py()
                    system, base = filesystem(directory)
                    system.create_dir(base, recursive=True)
                    name = f"ids-{number:06d}.bin"
                    trial = f"{base}/.{name}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(trial)
                    writer = Writer(out, bits)
                ids, at = encode(column.slice(a, b - a))
                for k, doc_id in enumerate(batch.column("doc_id").slice(a, b - a).to_pylist()):
                    writer.add(doc_id, ids[at[k] : at[k + 1]], end_id)
        if writer is not None:
            head = writer.close()
            out.close()
            system.move(trial, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([number], pa.int32()), "path": [f"{directory}/{name}"],
                "n_ids": pa.array([head["n_ids"]], pa.int64()), "n_docs": pa.array([head["n_docs"]], pa.int64()),
            })

    written = dealt.select(F.col("__file").alias("file"), "doc_id", F.col("text").cast("string").alias("text"))
    made = sorted(written.mapInArrow(write, "file int, path string, n_ids long, n_docs long").collect())
    if sum(r.n_docs for r in made) != n:
        raise RuntimeError("the files do not hold every document")
    before, manifest = 0, []
    for r in made:
        manifest.append((r.path, before, r.n_ids, r.n_docs))
        before += r.n_ids
    return spark.createDataFrame(manifest, "path string, first_id long, n_ids long, n_docs long")


def read_token_files(manifest: DataFrame, docs_per_step: int = 2000) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file is read by one task, a step of documents at a time. ``ids_crc32`` is the unsigned
    crc32 of the ids, read back and unpacked, as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, base = filesystem(row["path"])
                with system.open_input_file(base) as source:
                    file = Reader(source)
                    n = len(file.sizes)
                    for a in range(0, n, docs_per_step):
                        b = min(n, a + docs_per_step)
                        sums = []
                        k = a
                        while k < b:  # about a million ids at once
                            e = max(k + 1, min(b, int(np.searchsorted(file.starts, file.starts[k] + (1 << 20), side="right")) - 1))
                            ids = file.ids(int(file.starts[k]), int(file.starts[e])).astype("<u4")
                            at = file.starts[k : e + 1] - file.starts[k]
                            sums += [zlib.crc32(ids[at[j] : at[j + 1]]) for j in range(e - k)]
                            k = e
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(file.doc_ids[a:b].astype(np.int64), mask=file.has_id[a:b] == 0),
                                pa.array(row["first_id"] + file.starts[a:b]),
                                pa.array(file.sizes[a:b].astype(np.int64)),
                                pa.array(np.array(sums, np.int64)),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = manifest.repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
