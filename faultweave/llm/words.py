"""Vectorised word hashing over Arrow string columns.

A batch of texts is one byte buffer. A table sends each byte to its folded form plus
1, or to 0 if it separates words; words are runs of other bytes inside one text. A word's hash
is a polynomial in random 64-bit values of its bytes, taken from a running sum, so that
no step is a loop over words. Sums run over pieces of bounded size, in long texts too.
Hashes depend on nothing but the word's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a single longer text is handled alone.
CHUNK = 1 << 18
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random value for each folded byte; 0, a separator, counts nothing.
_RANDOM = mix(np.arange(257, dtype=U) * U(0xA0761D6478BD642F))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            p, q = U(_P), U(pow(_P, -1, 1 << 64))
            n = max(n, CHUNK + 1)
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, p, U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, q, U)]))
        return self.up, self.down


_powers = _Powers()


def folding(separators: bytes | None = None, lower: bool = True) -> np.ndarray:
    """Byte table. Default: all ASCII but letters and digits separates. Bytes from 0x80
    on belong to words."""
    table = np.arange(1, 257, dtype=np.uint16)
    keep = np.ones(256, bool)
    if separators is None:
        keep[:128] = [chr(i).isalnum() for i in range(128)]
    else:
        keep[list(separators)] = False
    if lower:
        table[65:91] += 32
    table[~keep] = 0
    return table


#: Words of letters and digits, A-Z folded.
WORDS = folding()
#: Words between white space ``[\x20\x09-\x0D]``, A-Z folded.
TOKENS = folding(b"\t\n\x0b\x0c\r ")
#: The same, letter case kept.
CASED = folding(b"\t\n\x0b\x0c\r ", lower=False)


@dataclass
class Words:
    """The words of some texts: of text ``i`` those from ``first[i]`` to ``first[i + 1]``.
    ``begin`` and ``end`` are byte places in ``data``."""

    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


#: Marks, of which runs are words of their own where a table of kinds is given.
MARKS = np.zeros(256, bool)
MARKS[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def scan(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS, kinds: np.ndarray | None = None) -> Words:
    """The words of texts ``data[offsets[i]:offsets[i + 1]]``. With ``kinds`` a word also
    ends where the kind of its bytes changes."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    folded = table[data]
    inside = folded != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    if kinds is not None:
        kind = kinds[data]
        turn = inside[1:] & inside[:-1] & (kind[1:] != kind[:-1])
        start[1:] |= turn
        stop[:-1] |= turn
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] |= inside[edges]
    stop[edges - 1] |= inside[edges - 1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    value = np.empty(len(begin), U)
    i = 0
    while i < len(begin):
        # Words that end within one chunk; a single longer word is a piece alone.
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK, "right")))
        a, b = int(begin[i]), int(end[j - 1])
        up, down = _powers.get(b - a + 1)
        total = np.zeros(b - a + 1, U)
        np.cumsum(_RANDOM[folded[a:b]] * down[: b - a], out=total[1:])
        value[i:j] = mix((total[end[i:j] - a] - total[begin[i:j] - a]) * up[begin[i:j] - a])
        i = j
    return Words(value, begin, end, np.searchsorted(begin, offsets).astype(np.int64), data, offsets)


def scans(texts: pa.Array, table: np.ndarray = WORDS, size: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """``scan`` over a column, some texts at a time, each with the number of its first text."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets, size):
        yield i, scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; runs over the edge of a text are for the caller
    to leave out."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= U(_P)
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out ^ U(n))
