"""Write-ahead log segments: framing, records, a batch source and a writer.

    spark.dataSource.register(WalSource)
    spark.read.format("tsdb_wal").load(folder)      -> segment, rec_ord, rec_type, body

Records never reach over segments, so each segment is a partition. An incomplete record at the end of the last segment
is dropped wherever it was cut; damage anywhere else is an error. (Stricter readers accept only a cut between fragments.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.errors import TsdbError
from tidemark.functions.codecs import MASK64, crc32c, read_uvarint, read_varint, signed, uvarint, varint
from tidemark.sources import files

#: Fixed values of the format.
PAGE, HEADER, SEGMENT = 32 * 1024, 7, 128 * 1024 * 1024
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
COMPRESSED = 0x18
SERIES, SAMPLES_V2 = 1, 11
RECORD_TYPES = {1: "series", 2: "samples", 3: "tombstones", 4: "exemplars", 5: "mmap_markers", 6: "metadata", 7: "histogram_samples", 8: "float_histogram_samples", 9: "custom_buckets_histogram_samples", 10: "custom_buckets_float_histogram_samples", 11: "samples_v2", 12: "histogram_samples_v2", 13: "float_histogram_samples_v2"}


def frame(at: int, body: bytes) -> bytes:
    """A record's fragments, to be written at position ``at`` of a segment."""
    out = bytearray()
    begun = False
    while True:
        room = PAGE - (at + len(out)) % PAGE
        if room < HEADER:
            out += bytes(room)
            room = PAGE
        part, body = body[: room - HEADER], body[room - HEADER :]
        kind = (MIDDLE if begun else FIRST) if body else (LAST if begun else FULL)
        out += bytes([kind]) + len(part).to_bytes(2, "big") + crc32c(part).to_bytes(4, "big") + part
        begun = True
        if not body:
            return bytes(out)


def closing_pad(at: int) -> bytes:
    """Zeros up to the page's end."""
    return bytes(-at % PAGE)


def records(data: bytes, last_segment: bool = True) -> Iterator[bytes]:
    """The records of a segment's bytes."""
    at, parts = 0, None

    def cut_off(what: str) -> None:
        if not last_segment:
            raise TsdbError("illegal_byte_sequence", f"{what} at {at}")

    while at < len(data):
        end = at - at % PAGE + PAGE
        if data[at] & 0x07 == 0 and not data[at] & COMPRESSED:
            rest = data[at : min(end, len(data))]
            if any(rest):
                raise TsdbError("illegal_byte_sequence", f"padding at {at} is not zero")
            at = end
            continue
        if data[at] & COMPRESSED:
            raise TsdbError("not_supported", "compressed record")
        if at + HEADER > end:
            raise TsdbError("illegal_byte_sequence", f"no room for a header at {at}")
        if at + HEADER > len(data):
            return cut_off("header cut off")
        kind, size = data[at] & 0x07, int.from_bytes(data[at + 1 : at + 3], "big")
        if kind > LAST or data[at] & 0xE0 or at + HEADER + size > end:
            raise TsdbError("illegal_byte_sequence", f"bad fragment at {at}")
        body = data[at + HEADER : at + HEADER + size]
        if len(body) < size:
            return cut_off("fragment cut off")
        if crc32c(body) != int.from_bytes(data[at + 3 : at + 7], "big"):
            raise TsdbError("illegal_byte_sequence", f"checksum of the fragment at {at}")
        if (kind in (FULL, FIRST)) != (parts is None):
            raise TsdbError("illegal_byte_sequence", f"fragment of kind {kind} at {at} out of place")
        parts = [body] if parts is None else [*parts, body]
        if kind in (FULL, LAST):
            yield b"".join(parts)
            parts = None
        at += HEADER + size
    if parts is not None:
        cut_off("record not ended")


def encode_series(entries: Iterable[tuple[int, dict[str, str]]]) -> bytes:
    out = bytearray([SERIES])
    for ref, labels in entries:
        out += (ref & MASK64).to_bytes(8, "big") + uvarint(len(labels))
        for pair in sorted(labels.items()):
            for text in pair:
                raw = text.encode()
                out += uvarint(len(raw)) + raw
    return bytes(out)


def decode_series(body: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    at = _typed(body, SERIES)
    while at < len(body):
        if at + 8 > len(body):
            raise TsdbError("unexpected_end")
        ref, (n, at) = signed(int.from_bytes(body[at : at + 8], "big")), read_uvarint(body, at + 8)
        texts = []
        for _ in range(2 * n):
            size, at = read_uvarint(body, at)
            if at + size > len(body):
                raise TsdbError("unexpected_end")
            texts.append(body[at : at + size].decode())
            at += size
        yield ref, dict(zip(texts[::2], texts[1::2]))


def encode_samples(samples: Iterable[tuple[int, int, int, int]]) -> bytes:
    """Samples (ref, t, start time or 0, value bits)."""
    out = bytearray([SAMPLES_V2])
    first = before = None
    for ref, t, st, bits in samples:
        if first is None:
            first = (t, st)
            out += varint(ref) + varint(t) + varint(st)
        else:
            out += varint(signed(ref - before[0])) + varint(signed(t - first[0]))
            out += b"\x00" if st == 0 else b"\x01" if st == before[1] else b"\x02" + varint(signed(st - first[1]))
        out += (bits & MASK64).to_bytes(8, "big")
        before = (ref, st)
    return bytes(out)


def decode_samples(body: bytes) -> Iterator[tuple[int, int, int, int]]:
    at = _typed(body, SAMPLES_V2)
    first = before = None
    while at < len(body):
        ref, at = read_varint(body, at)
        t, at = read_varint(body, at)
        if first is None:
            st, at = read_varint(body, at)
            first = (t, st)
        else:
            ref, t = signed(before[0] + ref), signed(first[0] + t)
            marker = body[at] if at < len(body) else None
            at += 1
            if marker == 2:
                st, at = read_varint(body, at)
                st = signed(first[1] + st)
            elif marker in (0, 1):
                st = before[1] if marker else 0
            else:
                raise TsdbError("unexpected_end" if marker is None else "st_marker_invalid")
        if at + 8 > len(body):
            raise TsdbError("unexpected_end")
        yield ref, t, st, signed(int.from_bytes(body[at : at + 8], "big"))
        before, at = (ref, st), at + 8


def _typed(body: bytes, kind: int) -> int:
    if not body:
        raise TsdbError("unexpected_end", "empty record")
    if body[0] != kind:
        raise TsdbError("wrong_record_type", f"{body[0]} where {kind} was expected")
    return 1


class SegmentWriter:
    """Appends records to a folder of segments. It always begins a new segment, after all that are there."""

    def __init__(self, folder: str, limit: int = SEGMENT) -> None:
        files.make_dir(folder)
        self.folder, self.limit, self.closed = folder, limit, False
        there = files.numbered(folder, 8)
        self.index, self.data = (int(there[-1]) + 1 if there else 0), bytearray()
        self.sync()

    def log(self, body: bytes) -> None:
        if self.closed:
            raise TsdbError("operation_not_permitted", "closed")
        worst = len(body) + HEADER * (len(body) // (PAGE - HEADER) + 2) + PAGE
        if self.data and len(self.data) + worst > self.limit:
            self.cut()
        self.data += frame(len(self.data), body)

    def sync(self) -> None:
        files.write_bytes(f"{self.folder}/{self.index:08d}", bytes(self.data))

    def cut(self) -> None:
        self.data += closing_pad(len(self.data))
        self.sync()
        self.index, self.data = self.index + 1, bytearray()
        self.sync()

    def close(self) -> None:
        if not self.closed:
            self.sync()
            self.closed = True


class _Segment(InputPartition):
    def __init__(self, path: str, number: int, last: bool) -> None:
        self.path, self.number, self.last = path, number, last


class _WalReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        names = files.numbered(self.folder, 8)
        return [_Segment(f"{self.folder}/{n}", int(n), n == names[-1]) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, body in enumerate(records(files.read_bytes(partition.path), partition.last)):
            yield partition.number, i, (body[0] if body and body[0] in RECORD_TYPES else 255), body


class WalSource(DataSource):
    """Option ``path``: the folder of segments. A folder that is missing is an error."""

    @classmethod
    def name(cls) -> str:
        return "tsdb_wal"

    def schema(self) -> str:
        return "segment int, rec_ord long, rec_type int, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _WalReader(self.options["path"])


def _decoded(decode, names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, r, i, *x) for s, r, body in zip(*(c.to_pylist() for c in batch.columns)) for i, x in enumerate(decode(body))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=names)

    return run


def wal_series(log: DataFrame) -> DataFrame:
    """(segment, rec_ord, entry_ord, ref, labels) of the series records of a log."""
    names = ["segment", "rec_ord", "entry_ord", "ref", "labels"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string())]
    run = _decoded(lambda b: ((ref, list(labels.items())) for ref, labels in decode_series(b)), names, kinds)
    return log.where(F.col("rec_type") == SERIES).select("segment", "rec_ord", "body").mapInArrow(run, "segment int, rec_ord long, entry_ord int, ref long, labels map<string,string>")


def wal_samples(log: DataFrame) -> DataFrame:
    """(segment, rec_ord, sample_ord, ref, t, st, v_bits) of the sample records of a log."""
    names = ["segment", "rec_ord", "sample_ord", "ref", "t", "st", "v_bits"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    return log.where(F.col("rec_type") == SAMPLES_V2).select("segment", "rec_ord", "body").mapInArrow(_decoded(decode_samples, names, kinds), "segment int, rec_ord long, sample_ord int, ref long, t long, st long, v_bits long")


def skipped(log: DataFrame) -> DataFrame:
    """How many records of each kind a replay does not read."""
    return log.where(~F.col("rec_type").isin(SERIES, SAMPLES_V2)).groupBy("rec_type").agg(F.count("*").alias("records"))


def write_log(samples: DataFrame, folder: str, batch: int = 1000) -> None:
    """Write samples (ref, labels, t, v, arrival) as a log, in order of arrival, committing each ``batch``: a series record
    for refs not seen before, then a sample record. One writer, since a log is one sequence."""
    from tidemark.functions.xor import bits_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seen, fresh, rows, total = SegmentWriter(folder), set(), [], [], 0

        def commit() -> None:
            if fresh:
                writer.log(encode_series(fresh))
            if rows:
                writer.log(encode_samples(rows))
            fresh.clear()
            rows.clear()

        for b in batches:
            for ref, labels, t, v in zip(*(c.to_pylist() for c in b.columns)):
                if ref not in seen:
                    seen.add(ref)
                    fresh.append((ref, dict(labels)))
                rows.append((ref, t, 0, bits_of(v)))
                total += 1
                if len(rows) == batch:
                    commit()
        commit()
        writer.close()
        yield pa.RecordBatch.from_pydict({"written": pa.array([total], type=pa.int64())})

    ordered = samples.repartition(1).sortWithinPartitions("arrival").select("ref", "labels", "t", "v")
    ordered.mapInArrow(run, "written long").collect()
