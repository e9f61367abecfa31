"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly as the library does.

A text is the result of merging iff every two neighbouring tokens would also come out of
merging their joined strings. So tokens are tried from the longest match at a position down
(one Aho-Corasick pass finds the longest, a table of proper prefixes the next shorter ones), a
token is accepted if it is compatible with the one before it, and a position from which no
token leads on is marked in a bitfield and never entered again. Compatibility is found by
re-merging the two tokens and is remembered per pair.

The vocabulary (its size is fixed by the file) travels to the tasks in their closure; texts are
never shuffled, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, texts

SPACE = "▁"
#: Strings between spaces that a worker remembers, and the longest of them.
MEMORY, LONGEST = 250_000, 48


class PieceModel(NamedTuple):
    """Normal pieces with their merge scores, and the ids of single bytes."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    end_id: int


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver. Models that normalise texts or lack byte pieces are refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "ﬁ Ａ  x\t ẞ "
    if sp.decode(sp.encode(probe)) != probe or sp.encode("a")[:1] != sp.encode(" a")[1:][:1] and sp.decode(sp.encode(" a")) != " a":
        raise ValueError("only models that keep texts as they are can be used")
    ids = range(sp.get_piece_size())
    odd = [i for i in ids if sp.is_unused(i)]
    byte_ids = tuple(i for i in ids if sp.is_byte(i))
    if odd or len(byte_ids) != 256:
        raise ValueError("only models with byte fallback and without unused pieces can be used")
    normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    byte_ids = tuple(sorted(byte_ids, key=lambda i: int(sp.id_to_piece(i)[1:-1], 16)))
    return PieceModel({sp.id_to_piece(i): i for i in normal}, {sp.id_to_piece(i): sp.get_score(i) for i in normal}, byte_ids, sp.eos_id())


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model = model
        pieces = model.pieces
        #: Tokens are numbered here; single characters that only occur inside pieces get numbers too.
        inner = sorted({c for p in pieces if len(p) > 1 for c in p} - set(pieces))
        self.strings = [*pieces, *inner]
        number = {s: k for k, s in enumerate(self.strings)}
        self.ids = [(pieces[s],) if s in pieces else self._bytes(s) for s in self.strings]
        self.size = [len(s) for s in self.strings]
        self.number = number
        self.shorter = [next((number[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in number), -1) for s in self.strings]
        self.automaton = ahocorasick.Automaton()
        for s, k in number.items():
            self.automaton.add_word(s, (len(s), k))
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        known = {c for s in self.strings for c in s}
        # Where no piece spans a place, no merge does: at these breaks, and between a letter and these signs.
        spans = {pair for x in self.strings for pair in zip(x, x[1:])}
        letter = re.compile(r"[^\W\d_]")
        breaks = "".join(c for c in "\n\t\r\v\f" if not any(c in pair for pair in spans))
        signs = "".join(re.escape(c) for c in string.punctuation if not any(y == c and letter.match(x) for x, y in spans))
        word = rf"{SPACE}+[^\W\d_]+(?=[{signs}])|" if signs else ""
        self.unit = re.compile(word + f"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+" + (f"|[{breaks}]+" if breaks else ""))
        self.known = known
        self.spelt = [" ".join(map(str, i)) for i in self.ids]
        self.unknown = re.compile("([^" + re.escape("".join(sorted(known))) + "])")
        self.text_of = {i: s for s, i in pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(model.byte_ids)}
        self.memory: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.model.byte_ids[b] for b in text.encode("utf-8"))

    def merge(self, text: str) -> list[str]:
        """Merging as defined: the best-scored neighbours first, of equals the leftmost."""
        parts, never = list(text), float("-inf")
        score = lambda k: self.model.scores.get(parts[k] + parts[k + 1], never)
        near = [score(k) for k in range(len(parts) - 1)]
        while near and (best := max(near)) > never:
            at = near.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = score(at - 1)
            if at < len(near):
                near[at] = score(at)
        return parts

    def _stands(self, token: int) -> bool:
        """Whether the token's own string merges into it."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = len(self.merge(self.strings[token])) == 1
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging the joined strings gives these two tokens again."""
        key = left * len(self.strings) + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MEMORY:
                self.fits.clear()
            a, b = self.strings[left], self.strings[right]
            known = self.fits[key] = self._stands(left) and self._stands(right) and self.merge(a + b) == [a, b]
        return known

    def _tokens(self, text: str) -> list[int]:
        """Token numbers of a text all of whose characters are known."""
        n = len(text)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(text):
            longest[end - size + 1] = token  # a later end is a longer match
        open_at = bytearray(b"\1" * (n + 1))
        sizes, shorter, fits, base = self.size, self.shorter, self.fits, len(self.strings)
        out, pos, last, token = [], 0, -1, longest[0]
        while pos < n:
            end = pos + sizes[token]
            if open_at[end]:
                ok = fits.get(last * base + token) if last >= 0 else self._stands(token)
                if ok is None:
                    ok = self._follows(last, token)
                if ok:
                    out.append(token)
                    last, pos = token, end
                    token = longest[pos] if pos < n else -1
                    continue
            token = shorter[token]
            while token < 0:
                open_at[pos] = 0
                if not out:
                    raise ValueError("no sequence of pieces spells this text")
                last = out.pop()
                pos -= sizes[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of a string that merging treats on its own."""
        ids: list[int] = []
        for k, part in enumerate(self.unknown.split(unit)):
            if k % 2:
                ids += self._bytes(part)
            elif part:
                for token in self._tokens(part):
                    ids += self.ids[token]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the space before the first word goes, end and start ids are silent."""
        return self._surface(ids).removeprefix(SPACE).replace(SPACE, " ")

    def _surface(self, ids: Iterable[int]) -> str:
        try:
            return "".join([self.text_of[i] for i in ids])
        except KeyError:
            pass
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            out += [raw.decode("utf-8", "replace"), self.text_of.get(i, "")]
            raw.clear()
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def units(self, text: str) -> list[tuple[str, int, str]]:
        """Per unit of the text: its ids in decimal, their number, and the string they decode to."""
        if not text:
            return []
        if len(self.memory) > MEMORY:  # what was not used since the last turn is forgotten
            self.older, self.memory = self.memory, {}
        memory, older, out = self.memory, self.older, []
        for unit in self.unit.findall(SPACE + text.replace(" ", SPACE)):
            known = memory.get(unit)
            if known is None and (known := older.get(unit)) is not None:
                memory[unit] = known
            if known is None:
                if self.known.issuperset(unit):
                    tokens = self._tokens(unit)
                    ids = [i for k in tokens for i in self.ids[k]]
                    line = " ".join([self.spelt[k] for k in tokens])
                else:
                    ids = self.unit_ids(unit)
                    line = " ".join(map(str, ids))
                back = self._surface(ids)
                known = (line, len(ids), unit if back == unit else back)
                if len(unit) <= LONGEST:
                    memory[unit] = known
            out.append(known)
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text and the end id."""
        return [int(i) for u in self.units(text) for i in u[0].split()] + [self.model.end_id]


_CODECS: dict[int, Codec] = {}


def codec(model: PieceModel) -> Codec:
    """The worker's codec of a model, built once per process."""
    key = hash((tuple(model.pieces.items()), model.byte_ids, model.end_id))
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def encode_texts(docs: DataFrame, model: PieceModel, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, with the end id), digests of the ids and of the decoded text.

    Whole texts are encoded; a null or empty text has the end id alone and decodes to "".
    Rows stay as many as they are, repeated doc_ids included; other columns are left out, so
    their names cannot clash. ``ids_sha256`` is over the decimal ids joined by one space,
    ``decoded_sha256`` over the UTF-8 of the decoded text.
    """
    small_batches(docs.sparkSession)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        end = str(model.end_id)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sizes, id_hash, text_hash, flat = [], [], [], []
                for text in texts(part.column("text")):
                    units = code.units(text)
                    sizes.append(sum(u[1] for u in units) + 1)
                    line = " ".join([*[u[0] for u in units], end])
                    id_hash.append(hashlib.sha256(line.encode()).hexdigest())
                    back = "".join([u[2] for u in units]).removeprefix(SPACE).replace(SPACE, " ")
                    text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        flat.append(np.array(line.split(" "), np.int32))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(id_hash), pa.array(text_hash)]
                if with_ids:
                    at = np.zeros(len(sizes) + 1, np.int32)
                    np.cumsum(sizes, out=at[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(flat))))
                yield pa.RecordBatch.from_arrays(columns, fields.replace(",", " ").split()[0::2][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, fields)
