"""Words and shingles of whole Arrow string columns as 64-bit hashes, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lowered; bytes of UTF-8 above 0x7F
are never separators, so this equals the same rule over code points. A word's hash is a polynomial over its
bytes, read off prefix sums, then mixed; a shingle's hash is a polynomial over its words' hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, _BASE, dtype=U), np.full(n, _INVERSE, dtype=U)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_POWERS = _Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes each, one row at least."""
    _, offsets = text_buffers(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


class Scan:
    """The words of all texts of a column: bytes [first, last) of ``data``, and each text's words as ``bounds``."""

    def __init__(self, column: pa.Array, space: np.ndarray = _SPACE, latin: bool = False) -> None:
        raw, offsets = text_buffers(column)
        data = _LOWER[raw[int(offsets[0]) : int(offsets[-1])]]
        self.offsets = offsets = offsets - int(offsets[0])
        self.bounds = np.zeros(len(offsets), dtype=np.int64)
        self.first = self.last = np.zeros(0, dtype=np.int64)
        self.sums = self.down = np.zeros(1, dtype=U)
        if not len(data):
            return
        if latin:  # capitals of U+00C0-U+00DE
            data[1:] += (32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))).astype(np.uint8)
        inside = ~space[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]  # a word ends with its text even if the next text goes on without white space
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, self.down = _POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])
        self.bounds = np.searchsorted(self.first, offsets)

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Of the words, or of their first ``length`` bytes where they are longer (else of all of them)."""
        last = self.last if length is None else np.minimum(self.last, self.first + length)
        return mix((self.sums[last] - self.sums[self.first]) * self.down[self.first] + (last - self.first).astype(U))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the n + 1 offsets of each text's words among them."""
    scan = Scan(column)
    return scan.hashes(), scan.bounds


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    raw, offsets = text_buffers(column)
    inside = ~_SPACE[raw[int(offsets[0]) : int(offsets[-1])]]
    offsets = offsets - int(offsets[0])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(inside)]
    begins[starts] = inside[starts]
    total = np.concatenate(([0], np.cumsum(begins)))
    return total[offsets[1:]] - total[offsets[:-1]]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with each word's first and past-last byte, counted from its text's first byte."""
    scan = Scan(column)
    base = np.repeat(scan.offsets[:-1], np.diff(scan.bounds))
    return scan.hashes(), scan.bounds, scan.first - base, scan.last - base


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in text order, and their n + 1 offsets.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(bounds)
    found = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(found)))
    out = np.zeros(int(out_bounds[-1]), dtype=U)
    if not len(out):
        return out, out_bounds
    start = np.arange(len(out)) - np.repeat(out_bounds[:-1], found) + np.repeat(bounds[:-1], found)
    room = np.repeat(np.minimum(counts, n), found)
    for j in range(n):
        at = np.minimum(start + j, len(hashes) - 1)
        out = out * U(_BASE) + np.where(j < room, hashes[at], U(0))
    return mix(out ^ room.astype(U)), out_bounds


def runs(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n values from each place on, read off prefix sums of a polynomial."""
    up, down = _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * down[at])
