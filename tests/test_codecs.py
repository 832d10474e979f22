import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.errors import TsdbError
from tidemark.functions import codecs, histogram, xor

i64 = st.integers(-(1 << 63), (1 << 63) - 1)
u64 = st.integers(0, (1 << 64) - 1)


@pytest.mark.parametrize("value,spelled", [(0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (300, "ac02"), (16384, "808001"), ((1 << 64) - 1, "ff" * 9 + "01")])
def test_uvarint_vectors(value, spelled):
    assert codecs.uvarint(value).hex() == spelled
    assert codecs.read_uvarint(bytes.fromhex(spelled)) == (value, len(spelled) // 2)


@pytest.mark.parametrize("value,spelled", [(0, "00"), (-1, "01"), (1, "02"), (-2, "03"), (63, "7e"), (-64, "7f"), (64, "8001")])
def test_varint_vectors(value, spelled):
    assert codecs.varint(value).hex() == spelled


@given(i64)
def test_varint_round_trip(x):
    assert codecs.read_varint(codecs.varint(x))[0] == x


@pytest.mark.parametrize("data,code", [("", "end_of_stream"), ("80", "unexpected_end"), ("ff" * 10, "varint_overflow"), ("80" * 9 + "02", "varint_overflow")])
def test_varint_errors(data, code):
    with pytest.raises(TsdbError) as e:
        codecs.read_uvarint(bytes.fromhex(data))
    assert e.value.code == code


@pytest.mark.parametrize("text,crc", [("", 0), ("123456789", 0xE3069283), ("a", 0xC1D04330), ("abc", 0x364B3FB7), ("hello", 0x9A71BB4C), ("The quick brown fox jumps over the lazy dog", 0x22620404)])
def test_crc32c(text, crc):
    assert codecs.crc32c(text.encode()) == crc
    assert codecs.crc32c(text[4:].encode(), codecs.crc32c(text[:4].encode())) == crc


def test_bits():
    w = codecs.BitWriter()
    for b in (1, 0, 1, 1, 0, 0, 1, 0):
        w.bit(b)
    assert w.getvalue().hex() == "b2"
    w.reset()
    w.bit(1)
    w.byte(0xAB)
    assert w.getvalue().hex() == "d580"
    r = codecs.BitReader(bytes.fromhex("d580"))
    assert (r.bit(), r.byte(), r.bits(7), r.at_end()) == (1, 0xAB, 0, True)
    with pytest.raises(TsdbError):
        r.bit()


@given(st.lists(i64), st.lists(u64))
def test_varbit_round_trip(signed, unsigned):
    w = codecs.BitWriter()
    for x in signed:
        codecs.put_varbit_int(w, x)
    for x in unsigned:
        codecs.put_varbit_uint(w, x)
    r = codecs.BitReader(w.getvalue())
    assert [codecs.read_varbit_int(r) for _ in signed] == signed
    assert [codecs.read_varbit_uint(r) for _ in unsigned] == unsigned


@pytest.mark.parametrize("x,bits", [(0, 1), (4, 5), (-3, 5), (5, 9), (-4, 9), (32, 9), (33, 13), (-31, 9), (-32, 13), (1 << 62, 72)])
def test_varbit_widths(x, bits):
    w = codecs.BitWriter()
    codecs.put_varbit_int(w, x)
    assert w.count == bits


def test_ulid():
    assert codecs.encode_ulid(bytes(16)) == "0" * 26
    assert codecs.encode_ulid(b"\xff" * 16) == "7" + "Z" * 25
    assert codecs.new_ulid()[:10] <= codecs.new_ulid()[:10]


def test_chunk_ref():
    assert codecs.chunk_ref(0x12345678, 0x9ABCDEF0) == 0x123456789ABCDEF0
    assert codecs.split_chunk_ref(0x123456789ABCDEF0) == (0x12345678, 0x9ABCDEF0)


def samples(pairs):
    return [(t, xor.bits_of(v)) for t, v in pairs]


def test_xor_fixed_cases():
    assert xor.encode([]) == b"\x00\x00"
    constant = samples((i * 1000, 42.0) for i in range(100))
    assert len(xor.encode(constant)) < 64
    growing = samples((15 * i + i**k, 0.5 * (i // 3)) for i, k in ((i, 6 if i > 4 else 2) for i in range(12)))
    falling = samples((60_000 * i - 90 * i * i, 7.25 - i % 2) for i in range(20))
    for s in (constant, growing, falling):
        assert list(xor.decode(xor.encode(s))) == s


@pytest.mark.parametrize("dod,bits", [(0, 1), (8192, 16), (-8191, 16), (8193, 20), (-8192, 20), (65536, 20), (65537, 24), (-65535, 20), (-65536, 24), (524288, 24), (524289, 68), (-524287, 24), (-524288, 68)])
def test_dod_classes(dod, bits):
    a = xor.XorAppender()
    a.append(0, 0)
    a.append(1_000_000, 0)
    before = a.w.count
    a.append(2_000_000 + dod, 0)
    assert a.w.count - before == bits + 1  # one bit for the equal value
    assert list(xor.decode(a.getvalue()))[-1] == (2_000_000 + dod, 0)


@given(st.lists(st.tuples(st.integers(0, 1 << 40), u64), max_size=200))
def test_xor_round_trip(steps):
    t, rows = -(1 << 40), []
    for step, bits in steps:
        t += step
        rows.append((t, bits))
    assert list(xor.decode(xor.encode(rows))) == rows


def test_special_values_keep_their_bits():
    rows = [(i, b) for i, b in enumerate((0x7FF0000000000002, 0x7FF8000000000001, 0x8000000000000000, xor.bits_of(float("inf")), xor.bits_of(float("-inf")), 1))]
    assert list(xor.decode(xor.encode(rows))) == rows


def test_chunks_are_cut_by_size():
    rng = random.Random(1)
    rows = [(i * 1000, struct.unpack(">Q", rng.randbytes(8))[0]) for i in range(5000)]
    parts = list(xor.cut(rows))
    assert all(len(c[3]) <= xor.TARGET_BYTES for c in parts) and len(parts) > 1
    assert [s for c in parts for s in xor.decode(c[3])] == rows
    assert all(c[:3] == (s[0][0], s[-1][0], len(s)) for c in parts for s in [list(xor.decode(c[3]))])


def test_sample_limit():
    a = xor.XorAppender()
    a.n = xor.MAX_SAMPLES
    assert a.append(0, 0) is False


def test_decoding_stops_at_damage():
    chunk = xor.encode(samples((i, float(i)) for i in range(20)))
    with pytest.raises(TsdbError):
        list(xor.decode(chunk[:-5]))


H = histogram.Histogram


def test_histogram_round_trip():
    spans = ((0, 2), (1, 1))
    rows = [(1000 * i, H(10 * i, i, xor.bits_of(i * 1.5), 1, 2.0**-128, spans, ((-2, 1),), (i, i, 2 * i), (i * i,))) for i in range(30)]
    a = histogram.HistogramAppender()
    assert all(a.append(*r) for r in rows)
    assert list(histogram.decode(a.getvalue())) == rows
    assert histogram.HistogramAppender().getvalue() == b"\x00\x00\x00"


def test_histogram_custom_bounds_and_header():
    h = H(3, 0, xor.bits_of(4.0), histogram.CUSTOM_SCHEMA, 0.0, ((0, 3),), (), (1, 0, 0), (), (0.005, 1.0, 2.00001))
    a = histogram.HistogramAppender(histogram.GAUGE)
    assert a.append(7, h)
    assert list(histogram.decode(a.getvalue())) == [(7, h)]
    assert histogram.reset_header(a.getvalue()) == histogram.GAUGE


def test_histogram_stale_samples():
    plain = H(3, 0, xor.bits_of(4.0), 0, 0.0, ((0, 1),), (), (3,))
    a = histogram.HistogramAppender()
    assert a.append(1, plain) and a.append(2, H(0, 0, histogram.STALE))
    assert not a.append(3, plain)
    got = list(histogram.decode(a.getvalue()))
    assert got[0] == (1, plain) and got[1][0] == 2 and got[1][1].stale and got[1][1].pos == ()


@pytest.mark.parametrize("change", [{"schema": 2}, {"zero_threshold": 0.5}, {"count": 1}, {"zero_count": 0}, {"pos_spans": ((0, 1),), "pos": (5,)}, {"pos": (1, 9)}])
def test_histogram_refusals(change):
    base = {"count": 9, "zero_count": 1, "sum_bits": 0, "pos_spans": ((0, 2),), "pos": (4, 1)}
    a = histogram.HistogramAppender()
    assert a.append(0, H(**base))
    assert not a.append(1, H(**base | change))
    assert not a.append(1, H(**base), reset=True)
    assert a.append(1, H(**base))


@pytest.mark.parametrize("x,byte", [(0.0, 0), (2.0**-128, 0x74), (2.0**10, 0xFE), (2.0**-243, 1), (0.3, 0xFF)])
def test_zero_threshold(x, byte):
    w = codecs.BitWriter()
    histogram.put_zero_threshold(w, x)
    assert w.getvalue()[0] == byte
    assert histogram.read_zero_threshold(codecs.BitReader(w.getvalue())) == x
