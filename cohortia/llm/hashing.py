"""Word and window hashes computed on the UTF-8 bytes of Arrow string columns.

A word is a run of bytes that are not separators. Every function works on whole texts and
never builds Python strings, so a batch costs a few numpy passes over its bytes.
All hashes are 64-bit, fixed by constants here, and equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BYTE_BASE = 0x5851F42D4C957F2D
_WORD_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a finaliser of two multiply-shift rounds)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of ``x`` and how often each occurs, by one sort in little memory."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return x[at], np.diff(at, append=len(x))


class Alphabet(NamedTuple):
    """Which bytes separate words and the value each other byte adds to a word's hash."""

    sep: np.ndarray
    value: np.ndarray


def alphabet(lower: bool = False, letters: bool = False, digits: bool = False) -> Alphabet:
    """White space is 0x20 and 0x09-0x0D; ``letters`` separates at every other ASCII byte but letters (and ``digits``)."""
    code = np.arange(256)
    fold = np.where((code >= 65) & (code <= 90), code + 32, code) if lower else code
    if letters:
        sep = (code < 128) & ~(((code | 32) >= 97) & ((code | 32) <= 122)) & ~(digits & (code >= 48) & (code <= 57))
    else:
        sep = (code == 32) | ((code >= 9) & (code <= 13))
    value = mix((fold.astype(_U) + _U(1)) * _U(_STEP))
    value[sep] = 0
    return Alphabet(sep, value)


class _Powers:
    """Growing tables of base**i and base**-i modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                factors = np.full(size, base, _U)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


_POWERS = {b: _Powers(b) for b in (_BYTE_BASE, *_WORD_BASES)}


class Words(NamedTuple):
    """Words of consecutive texts: ``first[d]:first[d + 1]`` are those of text ``d``."""

    hashes: np.ndarray
    start: np.ndarray
    first: np.ndarray


def hash_words(data: np.ndarray, offsets: np.ndarray, abc: Alphabet) -> Words:
    """Hash every word of the texts ``data[offsets[d]:offsets[d + 1]]``; ``start`` counts in ``data``."""
    offsets = np.asarray(offsets, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        none = np.zeros(0, np.int64)
        return Words(none.astype(_U), none, np.zeros(len(offsets), np.int64))
    part = data[lo:hi]
    sep = abc.sep[part]
    after = np.empty(len(part), bool)
    after[0] = True
    after[1:] = sep[:-1]
    bounds = offsets[:-1] - lo
    after[bounds[bounds < len(part)]] = True
    start = np.flatnonzero(after & ~sep)
    first = np.searchsorted(start, offsets - lo)
    if not len(start):
        return Words(np.zeros(0, _U), start, first)
    gap = np.diff(start, append=len(part))
    up, _ = _POWERS[_BYTE_BASE].upto(int(gap.max()) + 1)
    begin = int(start[0])
    at = np.arange(begin, len(part), dtype=np.int32) - np.repeat(start.astype(np.int32), gap)
    value = abc.value[part[begin:]]
    value *= up[at]
    return Words(mix(np.add.reduceat(value, start - begin)), start + lo, first)


def window_hashes(words: Words, size: int, bases: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text and first word of every window of ``size`` words inside one text, and its hashes."""
    n = len(words.hashes)
    counts = np.diff(words.first)
    per = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), per)
    at = np.arange(len(text)) + np.repeat(words.first[:-1] - (np.cumsum(per) - per), per)
    out = []
    for base in _WORD_BASES[:bases]:
        up, down = _POWERS[base].upto(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(words.hashes * up[:n], out=sums[1:])
        out.append(mix((sums[at + size] - sums[at]) * down[at]))
    return text, at, out


class Members:
    """Membership in a fixed set of hashes, most misses decided by a small bitmap."""

    def __init__(self, values: np.ndarray, ordered: bool = False):
        """``ordered``: the values ascend and are distinct."""
        self.values = values if ordered else distinct(np.asarray(values, _U))[0]
        self.bits = max(10, min(24, int(len(self.values) * 12).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.values & _U((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x among the sorted ``values``, -1 where it is not among them."""
        out = np.full(len(x), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(x & _U((1 << self.bits) - 1)).astype(np.int64)])
        if len(maybe) and len(self.values):
            at = np.searchsorted(self.values, x[maybe])
            at[at == len(self.values)] = 0
            out[maybe] = np.where(self.values[at] == x[maybe], at, -1)
        return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; one long text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
