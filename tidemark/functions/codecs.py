"""Scalar codecs of the binary formats: varints, bit streams, CRC-32C, varbit, ULID, chunk references.

Decoders raise TsdbError with one of the codes end_of_stream, unexpected_end, varint_overflow.
"""

from __future__ import annotations

import os
import time

from tidemark.errors import TsdbError

MASK64 = (1 << 64) - 1
#: Fixed values of the formats.
CASTAGNOLI = 0x82F63B78
ULID_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
VARBIT_WIDTHS = (0, 3, 6, 9, 12, 18, 25, 56, 64)


def signed(x: int) -> int:
    """The low 64 bits as a signed number."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def zigzag(x: int) -> int:
    return ((x << 1) ^ (x >> 63)) & MASK64


def unzigzag(u: int) -> int:
    return (u >> 1) ^ -(u & 1)


def uvarint(x: int) -> bytes:
    out = bytearray()
    x &= MASK64
    while True:
        low, x = x & 0x7F, x >> 7
        out.append(low | (0x80 if x else 0))
        if not x:
            return bytes(out)


def varint(x: int) -> bytes:
    return uvarint(zigzag(x))


def _uvarint_from(next_byte) -> int:
    """Assemble a uvarint; next_byte() gives a byte or None at the end."""
    total = 0
    for i in range(10):
        b = next_byte()
        if b is None:
            raise TsdbError("end_of_stream" if i == 0 else "unexpected_end")
        if i == 9 and b > 1:
            break
        total |= (b & 0x7F) << (7 * i)
        if b < 0x80:
            return total
    raise TsdbError("varint_overflow")


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value and the position after it."""
    here = at

    def step():
        nonlocal here
        if here >= len(data):
            return None
        here += 1
        return data[here - 1]

    return _uvarint_from(step), here


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    value, at = read_uvarint(data, at)
    return unzigzag(value), at


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (CASTAGNOLI if c & 1 else 0)
        table.append(c)
    return table


_CRC = _crc_table()


def crc32c(data: bytes, state: int = 0) -> int:
    """CRC-32 with the Castagnoli polynomial; pass an earlier result as ``state`` to go on."""
    c = state ^ 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


class BitWriter:
    """Bits, most significant first, gathered in one growing number."""

    def __init__(self) -> None:
        self.value = self.count = 0

    def bits(self, value: int, n: int) -> None:
        self.value = self.value << n | value & ((1 << n) - 1)
        self.count += n

    def bit(self, b: bool | int) -> None:
        self.bits(int(bool(b)), 1)

    def byte(self, b: int) -> None:
        self.bits(b, 8)

    def put(self, data: bytes) -> None:
        self.bits(int.from_bytes(data, "big"), 8 * len(data))

    def getvalue(self) -> bytes:
        pad = -self.count % 8
        return (self.value << pad).to_bytes((self.count + pad) // 8, "big")

    def reset(self) -> None:
        self.value = self.count = 0


class BitReader:
    """Bits of a byte string, most significant first."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def bits(self, n: int) -> int:
        if n > self.left:
            raise TsdbError("unexpected_end" if self.left else "end_of_stream")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def bit(self) -> int:
        return self.bits(1)

    def byte(self) -> int:
        return self.bits(8)

    def uvarint(self) -> int:
        return _uvarint_from(lambda: self.bits(8) if self.left >= 8 else None)

    def varint(self) -> int:
        return unzigzag(self.uvarint())

    def at_end(self) -> bool:
        return self.left == 0


def fits(x: int, n: int) -> bool:
    """Whether x lies in -(2**(n-1) - 1) .. 2**(n-1): one step up from two's complement."""
    return -(1 << (n - 1)) < x <= 1 << (n - 1)


def unfold(bits: int, n: int) -> int:
    """The number that ``fits`` in n bits and has these bits."""
    return bits - (1 << n) if bits > 1 << (n - 1) else bits


def _put_varbit(w: BitWriter, value: int, k: int) -> None:
    """Prefix of class k, k ones and a zero (none after eight ones), then the payload."""
    w.bits((1 << (k + 1)) - 2 if k < 8 else 0xFF, min(k + 1, 8))
    w.bits(value, VARBIT_WIDTHS[k])


def put_varbit_int(w: BitWriter, x: int) -> None:
    k = 0 if x == 0 else next((i for i in range(1, 8) if fits(x, VARBIT_WIDTHS[i])), 8)
    _put_varbit(w, x, k)


def put_varbit_uint(w: BitWriter, x: int) -> None:
    k = 0 if x == 0 else next((i for i in range(1, 8) if x < 1 << VARBIT_WIDTHS[i]), 8)
    _put_varbit(w, x, k)


def _read_varbit(r: BitReader) -> tuple[int, int]:
    k = 0
    while k < 8 and r.bit():
        k += 1
    return r.bits(VARBIT_WIDTHS[k]), VARBIT_WIDTHS[k]


def read_varbit_int(r: BitReader) -> int:
    bits, n = _read_varbit(r)
    return signed(bits) if n == 64 else unfold(bits, n) if n else 0


def read_varbit_uint(r: BitReader) -> int:
    return _read_varbit(r)[0]


def encode_ulid(raw: bytes) -> str:
    """16 bytes as 26 characters of 5 bits, after two zero bits."""
    if len(raw) != 16:
        raise TsdbError("invalid_argument", "a ULID has 16 bytes")
    number = int.from_bytes(raw, "big")
    return "".join(ULID_ALPHABET[number >> shift & 31] for shift in range(125, -1, -5))


def new_ulid() -> str:
    return encode_ulid(int(time.time() * 1000).to_bytes(6, "big") + os.urandom(10))


def chunk_ref(seq: int, offset: int) -> int:
    return seq << 32 | offset


def split_chunk_ref(ref: int) -> tuple[int, int]:
    return ref >> 32 & 0xFFFFFFFF, ref & 0xFFFFFFFF
