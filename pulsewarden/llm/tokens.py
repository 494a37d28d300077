"""Words and hashes of whole Arrow batches of texts, without a Python step per word.

A string column is one run of UTF-8 bytes with offsets. Words are found by looking at
bytes, and hashed by prefix sums of ``value[byte] * base**place``: the difference of two
prefix sums, moved back to place 0, is a polynomial in the word's bytes alone. Work is
done in pieces, so that memory follows the piece and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once.
PIECE = 1 << 18
#: Bytes of texts whose words are held at once.
GROUP = 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two in order."""
    return mix(a * _U(0xD6E8FEB86659FD93) + mix(b + _U(0x632BE59BD9B4E019)))


@cache
def space_table() -> np.ndarray:
    """Blanks of ``[\\x20\\x09-\\x0D]``."""
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


@cache
def _values(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=_U)
    if lower:
        b[65:91] += _U(32)
    return mix(b + _U(0x1234567))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(PIECE + 1, base, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def groups(data: np.ndarray, offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some texts in order: where each begins and ends, and whose it is."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    #: Per text: the number of its words.
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Place of each text's first word, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def words(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray | None = None) -> Words:
    """Runs of bytes outside ``blanks`` (a table of 256), by default white space."""
    n = len(data)
    inside = ~(space_table() if blanks is None else blanks)[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Words(starts, ends, doc, np.bincount(doc, minlength=len(offsets) - 1).astype(np.int64))


def hashes(data: np.ndarray, w: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case if asked for."""
    power, inverse = _powers()
    values = _values(lower)
    out = np.empty(len(w.starts), _U)
    i, n = 0, len(w.starts)
    while i < n:
        at = w.starts[i]
        j = int(np.searchsorted(w.ends, at + PIECE, "right"))
        if j <= i:  # a word longer than a piece
            raw = data[at: w.ends[i]].tobytes()
            out[i] = int.from_bytes(blake2b(raw.lower() if lower else raw, digest_size=8).digest(), "little")
            i += 1
            continue
        end = w.ends[j - 1]
        sums = np.zeros(end - at + 1, _U)
        np.cumsum(values[data[at:end]] * power[: end - at], out=sums[1:])
        s, e = w.starts[i:j] - at, w.ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
        i = j
    return out


def ngram_hashes(h: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that lie in one text, and the place of their first words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1:])
    out = h[at]
    for k in range(1, n):
        out = pair(out, h[at + k])
    return out, at
