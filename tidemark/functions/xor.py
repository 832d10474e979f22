"""The XOR chunk: a count, then bit-packed samples (t, value bits).

Values travel as 64-bit patterns, so NaNs and signed zeros keep every bit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from tidemark.errors import TsdbError
from tidemark.functions.codecs import MASK64, BitReader, BitWriter, fits, signed, unfold, uvarint, varint

#: Class widths of delta-of-deltas, the count's limit, a chunk's target size and the room left for a sample.
DOD_WIDTHS = (14, 17, 20)
MAX_SAMPLES = 65_535
TARGET_BYTES = 1024
CUT_ABOVE = TARGET_BYTES - 19


def bits_of(v: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", v))[0]


def float_of(bits: int) -> float:
    return struct.unpack(">d", struct.pack(">Q", bits & MASK64))[0]


class XorState:
    """What both directions carry: the last bits and the window of meaningful bits."""

    def __init__(self) -> None:
        self.bits, self.leading, self.width = 0, 0, 0  # width 0: no window yet

    def write(self, w: BitWriter, bits: int) -> None:
        delta, self.bits = bits ^ self.bits, bits
        if not delta:
            w.bit(0)
            return
        leading = min(64 - delta.bit_length(), 31)
        trailing = (delta & -delta).bit_length() - 1
        floor = 64 - self.leading - self.width
        if self.width and leading >= self.leading and trailing >= floor:
            w.bits(0b10, 2)
            w.bits(delta >> floor, self.width)
            return
        self.leading, self.width = leading, 64 - leading - trailing
        w.bits(0b11, 2)
        w.bits(leading, 5)
        w.bits(self.width, 6)  # 64 is written as 0
        w.bits(delta >> trailing, self.width)

    def read(self, r: BitReader) -> int:
        if r.bit():
            if r.bit():
                self.leading, self.width = r.bits(5), r.bits(6) or 64
            if self.leading + self.width > 64 or not self.width:
                raise TsdbError("illegal_byte_sequence", "bad value window")
            self.bits ^= r.bits(self.width) << (64 - self.leading - self.width)
        return self.bits


class XorAppender:
    """Builds one chunk. append() is False, and changes nothing, when the count has reached its limit."""

    def __init__(self) -> None:
        self.w, self.n, self.t, self.delta, self.value = BitWriter(), 0, 0, 0, XorState()

    def append(self, t: int, bits: int) -> bool:
        if self.n == MAX_SAMPLES:
            return False
        if self.n == 0:
            self.w.put(varint(t))
            self.w.bits(bits, 64)
            self.value.bits = bits
        elif self.n == 1:
            self.delta = t - self.t
            self.w.put(uvarint(self.delta))
            self.value.write(self.w, bits)
        else:
            delta = t - self.t
            dod, self.delta = signed(delta - self.delta), delta
            k = 0 if dod == 0 else next((i for i, n in enumerate(DOD_WIDTHS, 1) if fits(dod, n)), 4)
            self.w.bits((1 << (k + 1)) - 2 if k < 4 else 0b1111, min(k + 1, 4))
            self.w.bits(dod, (0, *DOD_WIDTHS, 64)[k])
            self.value.write(self.w, bits)
        self.t = t
        self.n += 1
        return True

    def size(self) -> int:
        return 2 + (self.w.count + 7) // 8

    def getvalue(self) -> bytes:
        return self.n.to_bytes(2, "big") + self.w.getvalue()


def num_samples(chunk: bytes) -> int:
    if len(chunk) < 2:
        raise TsdbError("illegal_byte_sequence", "a chunk has 2 bytes at least")
    return int.from_bytes(chunk[:2], "big")


def encode(samples: Iterable[tuple[int, int]]) -> bytes:
    """One chunk of samples (t, value bits)."""
    a = XorAppender()
    for t, bits in samples:
        if not a.append(t, bits):
            raise TsdbError("invalid_argument", f"more than {MAX_SAMPLES} samples")
    return a.getvalue()


def decode(chunk: bytes) -> Iterator[tuple[int, int]]:
    """Samples (t, value bits) in order; an error ends the iteration."""
    n, r, state, t, delta = num_samples(chunk), BitReader(chunk[2:]), XorState(), 0, 0
    for i in range(n):
        if i == 0:
            t = r.varint()
            state.bits = r.bits(64)
        else:
            if i == 1:
                delta = r.uvarint()
            else:
                k = 0
                while k < 4 and r.bit():
                    k += 1
                width = (0, *DOD_WIDTHS, 64)[k]
                dod = signed(r.bits(64)) if width == 64 else unfold(r.bits(width), width) if width else 0
                delta = signed(delta + dod)
            t = signed(t + delta)
            state.read(r)
        yield t, state.bits


def cut(samples: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Chunks (min t, max t, count, bytes) of ordered samples, cut before a sample once they exceed CUT_ABOVE."""
    a, first = XorAppender(), None
    for t, bits in samples:
        if a.n and (a.size() > CUT_ABOVE or a.n == MAX_SAMPLES):
            yield first, a.t, a.n, a.getvalue()
            a = XorAppender()
        first = t if a.n == 0 else first
        a.append(t, bits)
    if a.n:
        yield first, a.t, a.n, a.getvalue()
