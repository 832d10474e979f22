"""The integer histogram chunk: a layout written once, then delta-of-delta samples in varbit code.

Appending refuses (returns False) where a sample does not fit the chunk's layout or its counters went back; the caller
then begins a new chunk. Layouts are never widened in place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from tidemark.errors import TsdbError
from tidemark.functions.codecs import BitReader, BitWriter, put_varbit_int, put_varbit_uint, read_varbit_int, read_varbit_uint, signed
from tidemark.functions.xor import MAX_SAMPLES, XorState, bits_of, float_of

#: The counter-reset header, the schema of custom buckets, the stale marker's bits.
UNKNOWN, NOT_RESET, RESET, GAUGE = 0b00, 0b01, 0b10, 0b11
CUSTOM_SCHEMA = -53
STALE = 0x7FF0000000000002


@dataclass(frozen=True)
class Histogram:
    """One sample; bucket values are differences from the bucket before, spans are (offset, length)."""

    count: int
    zero_count: int
    sum_bits: int
    schema: int = 0
    zero_threshold: float = 0.0
    pos_spans: tuple[tuple[int, int], ...] = ()
    neg_spans: tuple[tuple[int, int], ...] = ()
    pos: tuple[int, ...] = ()
    neg: tuple[int, ...] = ()
    bounds: tuple[float, ...] = ()

    @property
    def stale(self) -> bool:
        return self.sum_bits == STALE

    @property
    def layout(self) -> tuple:
        return self.schema, bits_of(self.zero_threshold), self.bounds, self.pos_spans, self.neg_spans


def put_zero_threshold(w: BitWriter, x: float) -> None:
    mantissa, exponent = math.frexp(x)
    if x == 0:
        w.byte(0)
    elif mantissa == 0.5 and -242 <= exponent <= 11:
        w.byte(exponent + 243)
    else:
        w.byte(0xFF)
        w.bits(bits_of(x), 64)


def read_zero_threshold(r: BitReader) -> float:
    b = r.byte()
    return 0.0 if b == 0 else float_of(r.bits(64)) if b == 0xFF else math.ldexp(0.5, b - 243)


def put_bounds(w: BitWriter, bounds: tuple[float, ...]) -> None:
    put_varbit_uint(w, len(bounds))
    for b in bounds:
        thousandths = b * 1000.0
        if 0 <= thousandths <= 33_554_430 and thousandths.is_integer():
            put_varbit_uint(w, int(thousandths) + 1)
        else:
            w.bit(0)
            w.bits(bits_of(b), 64)


def read_bounds(r: BitReader) -> tuple[float, ...]:
    found = []
    for _ in range(read_varbit_uint(r)):
        k = read_varbit_uint(r)
        found.append((k - 1) / 1000.0 if k else float_of(r.bits(64)))
    return tuple(found)


def _put_spans(w: BitWriter, spans: tuple[tuple[int, int], ...]) -> None:
    put_varbit_uint(w, len(spans))
    for offset, length in spans:
        put_varbit_uint(w, length)
        put_varbit_int(w, offset)


def _read_spans(r: BitReader) -> tuple[tuple[int, int], ...]:
    spans = []
    for _ in range(read_varbit_uint(r)):
        length = read_varbit_uint(r)
        spans.append((read_varbit_int(r), length))
    return tuple(spans)


@dataclass
class _Chain:
    """A number coded by the change of its change."""

    last: int = 0
    delta: int = 0

    def step(self, x: int) -> int:
        delta = signed(x - self.last)
        change, self.last, self.delta = signed(delta - self.delta), x, delta
        return change

    def undo(self, change: int) -> int:
        self.delta = signed(self.delta + change)
        self.last = signed(self.last + self.delta)
        return self.last


@dataclass
class HistogramAppender:
    reset_header: int = UNKNOWN
    w: BitWriter = field(default_factory=BitWriter)
    n: int = 0
    layout: tuple | None = None
    last: Histogram | None = None

    def _start(self, t: int, h: Histogram) -> None:
        self.layout = h.layout
        put_zero_threshold(self.w, h.zero_threshold)
        put_varbit_int(self.w, h.schema)
        _put_spans(self.w, h.pos_spans)
        _put_spans(self.w, h.neg_spans)
        if h.schema == CUSTOM_SCHEMA:
            put_bounds(self.w, h.bounds)
        self.t, self.count, self.zero = _Chain(t), _Chain(h.count), _Chain(h.zero_count)
        self.pos, self.neg = [_Chain(b) for b in h.pos], [_Chain(b) for b in h.neg]
        self.sum = XorState()
        self.sum.bits = h.sum_bits
        put_varbit_int(self.w, t)
        put_varbit_uint(self.w, h.count)
        put_varbit_uint(self.w, h.zero_count)
        self.w.bits(h.sum_bits, 64)
        for b in (*h.pos, *h.neg):
            put_varbit_int(self.w, b)

    def _refuses(self, h: Histogram, reset: bool) -> bool:
        if self.n == MAX_SAMPLES or reset or (self.last.stale and not h.stale):
            return True
        if h.stale:
            return False
        if h.layout != self.layout:
            return True
        return self.reset_header != GAUGE and (h.count < self.last.count or h.zero_count < self.last.zero_count or _fell(self.last, h))

    def append(self, t: int, h: Histogram, reset: bool = False) -> bool:
        if sum(n for _, n in h.pos_spans) != len(h.pos) or sum(n for _, n in h.neg_spans) != len(h.neg):
            raise TsdbError("invalid_argument", "spans and buckets differ in number")
        if h.stale and self.n == 0:
            h = Histogram(0, 0, STALE, h.schema, h.zero_threshold, bounds=h.bounds)
        if self.n == 0:
            self._start(t, h)
        elif self._refuses(h, reset):
            return False
        else:
            put_varbit_int(self.w, self.t.step(t))
            # a stale sample has no counts: both changes are written as 0, and the chains go on as a reader's do
            put_varbit_int(self.w, 0 if h.stale else self.count.step(h.count))
            put_varbit_int(self.w, 0 if h.stale else self.zero.step(h.zero_count))
            if h.stale:
                self.count.undo(0)
                self.zero.undo(0)
            self.sum.write(self.w, h.sum_bits)
            if not h.stale:
                for chain, b in zip((*self.pos, *self.neg), (*h.pos, *h.neg)):
                    put_varbit_int(self.w, chain.step(b))
        self.n, self.last = self.n + 1, h
        return True

    def getvalue(self) -> bytes:
        return self.n.to_bytes(2, "big") + bytes([self.reset_header << 6]) + self.w.getvalue()


def _fell(before: Histogram, now: Histogram) -> bool:
    """Whether the count of any bucket went down; values are differences along the buckets."""
    for old, new in ((before.pos, now.pos), (before.neg, now.neg)):
        a = b = 0
        for x, y in zip(old, new):
            a, b = a + x, b + y
            if b < a:
                return True
    return False


def decode(chunk: bytes) -> Iterator[tuple[int, Histogram]]:
    if len(chunk) < 3:
        raise TsdbError("illegal_byte_sequence", "a histogram chunk has 3 bytes at least")
    n, r = int.from_bytes(chunk[:2], "big"), BitReader(chunk[3:])
    if not n:
        return
    threshold, schema = read_zero_threshold(r), read_varbit_int(r)
    pos_spans, neg_spans = _read_spans(r), _read_spans(r)
    bounds = read_bounds(r) if schema == CUSTOM_SCHEMA else ()
    t, count, zero = _Chain(read_varbit_int(r)), _Chain(read_varbit_uint(r)), _Chain(read_varbit_uint(r))
    total = XorState()
    total.bits = r.bits(64)
    pos = [_Chain(read_varbit_int(r)) for _ in range(sum(k for _, k in pos_spans))]
    neg = [_Chain(read_varbit_int(r)) for _ in range(sum(k for _, k in neg_spans))]
    for i in range(n):
        if i:
            t.undo(read_varbit_int(r))
            count.undo(read_varbit_int(r))
            zero.undo(read_varbit_int(r))
            total.read(r)
            if total.bits != STALE:
                for chain in (*pos, *neg):
                    chain.undo(read_varbit_int(r))
        if total.bits == STALE:
            yield t.last, Histogram(0, 0, STALE, schema, threshold, bounds=bounds)
        else:
            yield t.last, Histogram(count.last, zero.last, total.bits, schema, threshold, pos_spans, neg_spans, tuple(c.last for c in pos), tuple(c.last for c in neg), bounds)


def reset_header(chunk: bytes) -> int:
    return chunk[2] >> 6
