"""Binary blocks: meta.json, index, chunk segments; a batch source and a writer.

    spark.dataSource.register(BlockSource)
    spark.read.format("tsdb_block").load(folder)
        -> block_ulid, series_ref, labels, chunk_ord, min_time, max_time, chunk_ref, encoding, data

The index is read once to plan the scan: each partition holds chunk references of one segment, so chunks are read in
parallel, by byte range and in order. Options ``mint`` and ``maxt`` leave out chunks, and blocks, and ``pairs`` (as
``select_block`` makes them of matchers) leaves out series by their postings, before any chunk is read. Index versions 1
to 3 are read, version 2 is written.
"""

from __future__ import annotations

import json
import pickle
import tempfile
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.errors import TsdbError
from tidemark.functions.codecs import chunk_ref, crc32c, new_ulid, read_uvarint, read_varint, split_chunk_ref, uvarint, varint
from tidemark.functions.xor import num_samples
from tidemark.model import Matcher
from tidemark.sources import files

#: Fixed values of the format.
INDEX_MAGIC, CHUNKS_MAGIC, INDEX_VERSION = bytes.fromhex("BAAAD700"), bytes.fromhex("85BD40DD"), 2
TOC_SIZE, SEGMENT_LIMIT, SERIES_ALIGN, POSTINGS_ALIGN = 52, 512 * 1024 * 1024, 16, 4
ENCODINGS = {0: "none", 1: "XOR", 2: "histogram", 3: "floathistogram", 4: "XOR2"}
_STATS = {"num_samples": "numSamples", "num_float_samples": "numFloatSamples", "num_histogram_samples": "numHistogramSamples", "num_series": "numSeries", "num_chunks": "numChunks", "num_tombstones": "numTombstones"}


def _broken(what: str) -> TsdbError:
    return TsdbError("illegal_byte_sequence", what)


@dataclass
class BlockMeta:
    ulid: str = ""
    min_time: int = 0
    max_time: int = 0
    stats: dict[str, int] = field(default_factory=dict)
    level: int = 0
    sources: list[str] = field(default_factory=list)
    parents: list[dict] = field(default_factory=list)
    deletable: bool = False
    failed: bool = False
    hints: list[str] = field(default_factory=list)
    version: int = 1

    @staticmethod
    def from_json(text: str | bytes) -> BlockMeta:
        """Unknown fields are ignored, missing ones have their defaults; a version other than 1 is an error."""
        try:
            raw = json.loads(text)
            get = lambda of, key, default, kind: default if of.get(key) is None else _typed(of[key], kind)
            version = get(raw, "version", 1, int)
            if version != 1:
                raise TsdbError("invalid_argument", f"meta version {version}")
            stats, c = get(raw, "stats", {}, dict), get(raw, "compaction", {}, dict)
            return BlockMeta(
                get(raw, "ulid", "", str), get(raw, "minTime", 0, int), get(raw, "maxTime", 0, int),
                {k: n for k, j in _STATS.items() if (n := get(stats, j, 0, int))}, get(c, "level", 0, int), get(c, "sources", [], list),
                get(c, "parents", [], list), get(c, "deletable", False, bool), get(c, "failed", False, bool), get(c, "hints", [], list),
            )
        except (ValueError, AttributeError, TypeError) as e:
            raise TsdbError("invalid_argument", f"meta.json: {e}") from e

    def to_json(self) -> str:
        compaction = {"level": self.level, "sources": self.sources, "deletable": self.deletable, "parents": self.parents, "failed": self.failed, "hints": self.hints}
        out = {"version": self.version, "ulid": self.ulid, "minTime": self.min_time, "maxTime": self.max_time}
        out["stats"] = {j: self.stats[k] for k, j in _STATS.items() if self.stats.get(k)}
        out["compaction"] = {k: v for k, v in compaction.items() if v or k == "level"}
        return json.dumps(out, indent="\t", ensure_ascii=False)


def _typed(value, kind: type):
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise TypeError(f"{value!r} is not {kind.__name__}")
    return value


def read_meta(folder: str) -> BlockMeta:
    return BlockMeta.from_json(files.read_bytes(f"{folder}/meta.json"))


def write_meta(folder: str, meta: BlockMeta) -> None:
    files.write_bytes(f"{folder}/meta.json", meta.to_json().encode())


def _section(data: bytes, at: int) -> bytes:
    """The payload of a section that begins with its length, after its checksum held."""
    if at + 4 > len(data):
        raise _broken(f"section at {at} is outside")
    size = int.from_bytes(data[at : at + 4], "big")
    body = data[at + 4 : at + 4 + size]
    if len(body) < size or data[at + 4 + size : at + 8 + size] != crc32c(body).to_bytes(4, "big"):
        raise _broken(f"section at {at}")
    return body


@dataclass(frozen=True)
class ChunkMeta:
    min_time: int
    max_time: int
    ref: int


class Index:
    """A parsed index file."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 5 + TOC_SIZE or data[:4] != INDEX_MAGIC:
            raise _broken("not an index")
        self.version = data[4]
        if self.version not in (1, 2, 3):
            raise TsdbError("not_supported", f"index version {self.version}")
        toc = data[-TOC_SIZE:]
        if crc32c(toc[:48]) != int.from_bytes(toc[48:], "big"):
            raise _broken("table of contents")
        self.toc = dict(zip(("symbols", "series", "label_indices", "label_table", "postings", "postings_table"), (int.from_bytes(toc[i : i + 8], "big") for i in range(0, 48, 8))))
        self.data = data
        self.symbols = self._symbols()
        self.postings_table = self._postings_table()

    def _symbols(self) -> dict[int, str]:
        """By reference: the file offset in version 1, the position later."""
        base = self.toc["symbols"]
        body = _section(self.data, base)
        found, at = {}, 4
        for i in range(int.from_bytes(body[:4], "big")):
            ref = base + 4 + at if self.version == 1 else i
            size, at = read_uvarint(body, at)
            if at + size > len(body):
                raise _broken("symbol")
            found[ref] = body[at : at + size].decode()
            at += size
        return found

    def symbol(self, ref: int) -> str:
        if ref not in self.symbols:
            raise TsdbError("result_out_of_range", f"symbol {ref}")
        return self.symbols[ref]

    def _postings_table(self) -> dict[tuple[str, str], int]:
        body = _section(self.data, self.toc["postings_table"])
        found, at = {}, 4
        for _ in range(int.from_bytes(body[:4], "big")):
            keys, at = read_uvarint(body, at)
            if keys != 2:
                raise _broken(f"{keys} keys in the postings table")
            pair = []
            for _ in range(2):
                size, at = read_uvarint(body, at)
                pair.append(body[at : at + size].decode())
                at += size
            found[pair[0], pair[1]], at = read_uvarint(body, at)
        if at != len(body):
            raise _broken("bytes after the postings table")
        return found

    def postings(self, name: str, value: str) -> list[int]:
        at = self.postings_table.get((name, value))
        return [] if at is None else self.read_postings(at)

    def read_postings(self, at: int) -> list[int]:
        body = _section(self.data, at)
        n = int.from_bytes(body[:4], "big")
        if len(body) != 4 + 4 * n:
            raise _broken("posting list")
        return [int.from_bytes(body[i : i + 4], "big") for i in range(4, len(body), 4)]

    def postings_for_name(self, name: str) -> list[int]:
        return sorted({i for (n, _), at in self.postings_table.items() if n == name for i in self.read_postings(at)})

    def all_postings(self) -> list[int]:
        return sorted({i for at in self.postings_table.values() for i in self.read_postings(at)})

    def select(self, pairs: Iterable[tuple[str, list[str], bool]]) -> list[int]:
        """The series that all conditions (name, values, held) let through: those that hold one of the values, or none."""
        found: set[int] | None = None
        for name, values, held in pairs:
            listed = {i for v in values for i in self.postings(name, v)}
            if found is None:
                found = listed if held else set(self.all_postings()) - listed
            else:
                found = found & listed if held else found - listed
        return self.all_postings() if found is None else sorted(found)

    def label_values(self, name: str) -> list[str]:
        return sorted({v for n, v in self.postings_table if n == name})

    def series(self, ref: int) -> tuple[dict[str, str], list[ChunkMeta]]:
        size, at = read_uvarint(self.data, ref if self.version == 1 else ref * SERIES_ALIGN)
        body = self.data[at : at + size]
        if len(body) < size or self.data[at + size : at + size + 4] != crc32c(body).to_bytes(4, "big"):
            raise _broken(f"series {ref}")
        n, at = read_uvarint(body)
        labels = {}
        for _ in range(n):
            name, at = read_uvarint(body, at)
            value, at = read_uvarint(body, at)
            labels[self.symbol(name)] = self.symbol(value)
        n, at = read_uvarint(body, at)
        chunks, end, last = [], 0, 0
        for i in range(n):
            start, at = read_varint(body, at) if i == 0 else read_uvarint(body, at)
            start += end if i else 0
            length, at = read_uvarint(body, at)
            step, at = read_uvarint(body, at) if i == 0 else read_varint(body, at)
            end, last = start + length, last + step
            chunks.append(ChunkMeta(start, end, last))
        return labels, chunks


def encode_index(symbols: list[str], series: Iterable[tuple[dict[str, str], list[ChunkMeta]]]) -> tuple[bytes, Sequence[int]]:
    """A whole index file, and the series' references in input order."""
    if any(a >= b for a, b in zip(symbols, symbols[1:])):
        raise TsdbError("invalid_argument", "symbols must ascend")
    number = {s: i for i, s in enumerate(symbols)}
    out = bytearray(INDEX_MAGIC + bytes([INDEX_VERSION]))
    toc = {"symbols": len(out)}

    def section(body: bytes) -> None:
        out.extend(len(body).to_bytes(4, "big") + body + crc32c(body).to_bytes(4, "big"))

    texts = [s.encode() for s in symbols]
    section(len(symbols).to_bytes(4, "big") + b"".join(uvarint(len(t)) + t for t in texts))
    out.extend(bytes(-len(out) % SERIES_ALIGN))
    toc["series"] = len(out)
    refs, lists = array("Q"), defaultdict(lambda: array("Q"))  # lists by the numbers of name and value, which order as they do
    for labels, chunks in series:
        out.extend(bytes(-len(out) % SERIES_ALIGN))
        refs.append(len(out) // SERIES_ALIGN)
        body = bytearray(uvarint(len(labels)))
        for pair in sorted(labels.items()):
            lists[number[pair[0]], number[pair[1]]].append(refs[-1])
            body += b"".join(uvarint(number[s]) for s in pair)
        body += uvarint(len(chunks))
        before = None
        for c in chunks:
            body += varint(c.min_time) if before is None else uvarint(c.min_time - before.max_time)
            body += uvarint(c.max_time - c.min_time)
            body += uvarint(c.ref) if before is None else varint(c.ref - before.ref)
            before = c
        out.extend(uvarint(len(body)) + body + crc32c(bytes(body)).to_bytes(4, "big"))
    toc["label_indices"] = toc["label_table"] = len(out)
    table = bytearray(len(lists).to_bytes(4, "big"))
    out.extend(bytes(-len(out) % POSTINGS_ALIGN))
    toc["postings"] = len(out)
    for pair, ids in sorted(lists.items()):
        if any(a >= b for a, b in zip(ids, ids[1:])):
            raise TsdbError("invalid_argument", "postings must ascend")
        out.extend(bytes(-len(out) % POSTINGS_ALIGN))
        table += uvarint(2) + b"".join(uvarint(len(t)) + t for t in (texts[i] for i in pair)) + uvarint(len(out))
        section(len(ids).to_bytes(4, "big") + b"".join(i.to_bytes(4, "big") for i in ids))
    toc["postings_table"] = len(out)
    section(bytes(table))
    end = b"".join(toc[k].to_bytes(8, "big") for k in ("symbols", "series", "label_indices", "label_table", "postings", "postings_table"))
    return bytes(out + end + crc32c(end).to_bytes(4, "big")), refs


class ChunkWriter:
    """Chunk segments of a folder that holds none yet. A segment is streamed to its file; none is held."""

    def __init__(self, folder: str, limit: int = SEGMENT_LIMIT) -> None:
        files.make_dir(folder)
        if files.numbered(folder, 6):
            raise TsdbError("file_exists", folder)
        self.folder, self.limit, self.seq, self.size, self.out = folder, limit, 0, 0, None

    def write(self, encoding: int, body: bytes) -> int:
        record = uvarint(len(body)) + bytes([encoding]) + body + crc32c(bytes([encoding]) + body).to_bytes(4, "big")
        if self.size > 8 and self.size + len(record) > self.limit:
            self.close()
            self.seq += 1
        if self.out is None:
            self.out = files.Output(f"{self.folder}/{self.seq + 1:06d}")
            self._put(CHUNKS_MAGIC + b"\x01\x00\x00\x00")
        self._put(record)
        return chunk_ref(self.seq, self.size - len(record))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.size, self.out = 0, None


def _check_segment(head: bytes, name: str) -> None:
    if head[:4] != CHUNKS_MAGIC or head[4:5] != b"\x01":
        raise _broken(f"segment {name}")


def _chunk_at(data: bytes, at: int, check: bool = True) -> tuple[str, bytes, int]:
    """(encoding, bytes, position after it)."""
    size, body = read_uvarint(data, at)
    if body + 1 + size + 4 > len(data):
        raise _broken(f"chunk at {at}")
    raw = data[body : body + 1 + size]
    if check and crc32c(raw) != int.from_bytes(data[body + 1 + size : body + 5 + size], "big"):
        raise _broken(f"checksum of the chunk at {at}")
    if raw[0] not in ENCODINGS:
        raise _broken(f"encoding {raw[0]}")
    return ENCODINGS[raw[0]], raw[1:], body + 5 + size


def iterate_segment(data: bytes, name: str = "") -> Iterator[tuple[int, str, int]]:
    """(offset, encoding, size) of every chunk of a segment, checksums unread."""
    _check_segment(data, name)
    at = 8
    while at < len(data):
        encoding, body, end = _chunk_at(data, at, check=False)
        yield at, encoding, len(body)
        at = end


def _extent(path: str, offset: int) -> int:
    """How many bytes the chunk at an offset takes, with its length, encoding and checksum."""
    start = files.read_range(path, offset, 16) if offset >= 8 else b""
    if not start:
        raise _broken(f"chunk at {offset}")
    size, body = read_uvarint(start)
    return body + 1 + size + 4


def read_chunk(folder: str, ref: int) -> tuple[str, bytes]:
    """One chunk of a block's chunks folder."""
    seq, offset = split_chunk_ref(ref)
    names = files.numbered(folder, 6)
    if seq >= len(names):
        raise TsdbError("result_out_of_range", f"segment {seq}")
    path = f"{folder}/{names[seq]}"
    _check_segment(files.read_range(path, 0, 8), names[seq])
    return _chunk_at(files.read_range(path, offset, _extent(path, offset)), 0)[:2]


SeriesChunks = tuple[dict[str, str], Iterable[tuple[int, int, bytes]]]


def write_block(parent: str, series: Iterable[SeriesChunks], level: int = 1, sources: list[str] | None = None) -> str:
    """Write a block of series (labels, chunks as (min, max, XOR bytes)) in the order given; the new block's ULID.

    Series without chunks are left out. Chunks are taken one by one. The folder is complete when its meta.json is there.
    """
    ulid = new_ulid()
    folder = f"{parent}/{ulid}"
    if files.exists(folder):
        raise TsdbError("file_exists", folder)
    writer, symbols, samples, n_series, n_chunks, first, last = ChunkWriter(f"{folder}/chunks"), {""}, 0, 0, 0, None, None
    with tempfile.TemporaryFile() as spool:  # the index begins with all symbols: what follows waits in a file of this task's
        for labels, chunks in series:
            metas = []
            for lo, hi, body in chunks:
                metas.append((lo, hi, writer.write(1, body)))
                samples += num_samples(body)
            if not metas:
                continue
            pickle.dump((labels, metas), spool)
            symbols.update(labels.keys(), labels.values())
            lo, hi = min(m[0] for m in metas), max(m[1] for m in metas)
            first, last = (lo, hi) if first is None else (min(first, lo), max(last, hi))
            n_series, n_chunks = n_series + 1, n_chunks + len(metas)
        writer.close()
        spool.seek(0)
        entries = ((labels, [ChunkMeta(*m) for m in metas]) for labels, metas in (pickle.load(spool) for _ in range(n_series)))
        files.write_bytes(f"{folder}/index", encode_index(sorted(symbols, key=str.encode), entries)[0])
    files.write_bytes(f"{folder}/tombstones", b"")
    stats = {"num_samples": samples, "num_series": n_series, "num_chunks": n_chunks}
    write_meta(folder, BlockMeta(ulid, first or 0, last or 0, stats, level, sources or [ulid]))
    return ulid


def export_block(chunks: DataFrame, parent: str, level: int = 1, sources: list[str] | None = None) -> str:
    """Write chunk rows (series_key, chunk_ord, min_time, max_time, data) as one binary block: its ULID.

    A block has one index over all its series, so one task writes it, streaming over rows sorted by series. To write
    more than a task should, split by time range first; the native layout is Parquet.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        series = (({e["key"]: e["value"] for e in key}, (row[1:] for row in own)) for key, own in groupby(rows, key=itemgetter(0)))
        yield pa.RecordBatch.from_pydict({"ulid": [write_block(parent, series, level, sources)]})

    ordered = chunks.repartition(1).sortWithinPartitions("series_key", "min_time", "chunk_ord")
    return ordered.select("series_key", "min_time", "max_time", "data").mapInArrow(run, "ulid string").collect()[0]["ulid"]


class Block:
    """An opened block, for single reads; scans go through the source."""

    def __init__(self, folder: str) -> None:
        self.folder, self.meta, self.index = folder, read_meta(folder), Index(files.read_bytes(f"{folder}/index"))
        self.segments = files.numbered(f"{folder}/chunks", 6)

    def query(self, name: str, value: str) -> list[tuple[dict[str, str], list[bytes]]]:
        """All chunks of the series with exactly this pair, whatever their time."""
        out = []
        for ref in self.index.postings(name, value):
            labels, metas = self.index.series(ref)
            out.append((labels, [read_chunk(f"{self.folder}/chunks", m.ref)[1] for m in metas]))
        return out


#: Chunks of one partition are read in ranges of about so many bytes, over gaps of at most so many.
RANGE_BYTES, RANGE_GAP = 8 << 20, 64 << 10


class _Chunks(InputPartition):
    """Chunks of one segment in order of their offsets."""

    def __init__(self, ulid: str, path: str, rows: list[tuple]) -> None:
        self.ulid, self.path, self.rows = ulid, path, rows


def _ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (offset, ...) that are read together: near each other, and not too many bytes."""
    held: list[tuple] = []
    for row in rows:
        if held and (row[0] - held[-1][0] > RANGE_GAP or row[0] - held[0][0] > RANGE_BYTES):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.mint, self.maxt = options["path"], int(options.get("mint", -(1 << 63))), int(options.get("maxt", (1 << 63) - 1))
        self.per_partition = int(options.get("chunks_per_partition", 20_000))
        self.pairs = json.loads(options.get("pairs", "[]"))

    def partitions(self) -> list[InputPartition]:
        block = Block(self.folder)
        if not (block.meta.min_time <= self.maxt and block.meta.max_time >= self.mint) and block.meta.stats.get("num_chunks"):
            return []
        by_segment = defaultdict(list)
        for ref in block.index.select(self.pairs):
            labels, metas = block.index.series(ref)
            for i, m in enumerate(metas):
                if m.min_time <= self.maxt and m.max_time >= self.mint:
                    seq, offset = split_chunk_ref(m.ref)
                    by_segment[seq].append((offset, ref, labels, i, m.min_time, m.max_time, m.ref))
        out = []
        for seq, rows in sorted(by_segment.items()):
            if seq >= len(block.segments):
                raise TsdbError("result_out_of_range", f"segment {seq}")
            rows.sort(key=lambda r: r[0])
            for k in range(0, len(rows), self.per_partition):
                out.append(_Chunks(block.meta.ulid, f"{self.folder}/chunks/{block.segments[seq]}", rows[k : k + self.per_partition]))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        _check_segment(files.read_range(partition.path, 0, 8), partition.path)
        for rows in _ranges(partition.rows):
            base = rows[0][0]
            data = files.read_range(partition.path, base, rows[-1][0] - base + _extent(partition.path, rows[-1][0]))
            for offset, ref, labels, i, lo, hi, packed in rows:
                encoding, body, _ = _chunk_at(data, offset - base)
                yield partition.ulid, ref, labels, i, lo, hi, packed, encoding, body


class BlockSource(DataSource):
    """Option ``path``: the block's folder; ``mint`` and ``maxt`` leave out chunks that do not overlap, ``pairs`` series."""

    @classmethod
    def name(cls) -> str:
        return "tsdb_block"

    def schema(self) -> str:
        return "block_ulid string, series_ref long, labels map<string,string>, chunk_ord int, min_time long, max_time long, chunk_ref long, encoding string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from tidemark.sources.wal import WalSource

    spark.dataSource.register(BlockSource)
    spark.dataSource.register(WalSource)


def select_block(spark: SparkSession, folder: str, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
    """Whole chunks that overlap [mint, maxt], of the series that all matchers accept: only these are read.

    Each matcher becomes the values of its name in the index that it accepts or, where it accepts an absent label too, that
    it does not; a pattern is tried once on each value.
    """
    if not matchers:
        raise TsdbError("invalid_argument", "at least one matcher is needed")
    index, pairs = Block(folder).index, []
    for m in matchers:
        held = not m.matches("")
        values = [m.value] if m.kind in ("=", "!=") and m.value else index.label_values(m.name)
        pairs.append((m.name, [v for v in values if m.matches(v) == held], held))
    register(spark)
    return spark.read.format("tsdb_block").option("pairs", json.dumps(pairs)).option("mint", mint).option("maxt", maxt).load(folder)


def compact(spark: SparkSession, parent: str, folders: list[str]) -> str:
    """Compact blocks, in the order given: of samples with one time the last block's stays. Inputs are left as they are."""
    from functools import reduce

    from pyspark.sql import functions as F

    from tidemark.operators.blocks import compacted
    from tidemark.operators.chunks import decode_chunks, encode_chunks
    from tidemark.operators.select import xor_only

    if not folders:
        raise TsdbError("invalid_argument", "nothing to compact")
    metas = [read_meta(f) for f in folders]
    register(spark)
    read = [xor_only(spark.read.format("tsdb_block").load(f)).withColumn("block_ord", F.lit(i)) for i, f in enumerate(folders)]
    flat = decode_chunks(reduce(DataFrame.unionByName, read), "block_ord", "labels", "chunk_ord")
    merged = encode_chunks(compacted(flat, "chunk_ord", "sample_ord"))
    return export_block(merged, parent, max(m.level for m in metas) + 1, sorted({s for m in metas for s in m.sources}))
