"""WARC archives with revisit records and a two-level capture index.

Archives: one gzip member a record, so every record can be read by its range. Of captures with equal payloads of at
least ``MIN_REVISIT`` bytes, that with the largest page_id is a response and the others are revisits of it; their block
holds the HTTP header of the full payload. Each task writes its own archive and only the manifest of tasks that ended
well names archives, so a task that runs again leaves an unused file and nothing else.

Index: captures sorted by reversed-host key go into compressed blocks of ``BLOCK`` lines, range by range. A shard of
the index is one file of such blocks; its sparse directory has a line for each block (first key, offset, length). The
directory of a shard is read by the task that needs it, and the shards' first keys (as many as there are shards) route
lookups. A lookup bisects the directory, reads one block by range, bisects its lines, and reads records by range.

Files are reached through pyarrow's file systems, at the URI that the cluster shares (file, hdfs, s3, gs).

Defined cases: a null html is an empty payload; a null url has the empty key; a null page_id is written without one,
never a response that others refer to by number unless it is alone; repeated rows of the response are all responses;
payloads of any length are written whole; an empty table makes an empty index; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, fresh_path, shuffle_width

MIN_REVISIT, BLOCK, SALTS = 1000, 512, 32
#: Ranges nearer than this are read in one go.
NEAR = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query; without scheme, user, default port, fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        return url.strip().lower()
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    path = parts.path or "/"
    return ",".join(reversed(host.split("."))) + port + ")" + path + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str, html: str | None, digest: str, refers_to: int | None) -> bytes:
    """One record, as the bytes of its gzip member."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> dict:
    """A record's fields. A response's payload must have the digest that its header states."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    if field["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['warc-record-id']} does not match its digest")
    number = lambda v: int(v[10:-1]) if v and v != "<urn:page:>" else None
    return {"page_id": number(field["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": field["warc-type"], "refers_to": number(field.get("warc-refers-to"))}


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """A file under a folder that appears under its name when it is complete."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.system, path = _opened(folder)
        self.system.create_dir(path, recursive=True)
        self.name = uuid.uuid4().hex + suffix
        self.part, self.path, self.at = f"{path}/.{self.name}", f"{path}/{self.name}", 0
        self.out = self.system.open_output_stream(self.part, compression=None)  # members are compressed already

    def put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


CAPTURE = "key string, page_id long, url string, archive string, offset long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                writer = writer or _Writer(folder, ".warc.gz")
                at, size = writer.put(record(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"]))
                held.append((surt(row["url"]), row["page_id"], row["url"], writer.name, at, size))
        if writer:
            writer.close()
            for k in range(0, len(held), 10_000):  # only now: rows name a file that is there
                columns = list(zip(*held[k : k + 10_000]))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in CAPTURE.split(", ")])

    return run


def with_decisions(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages (page_id, url, html) with the payload's digest and, for revisits, the page they refer to.

    Only digests, lengths and ids are grouped; pages meet their group's largest id by (digest, salt), so one payload
    that a third of all pages share is spread over tasks.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    long = rows.where(F.octet_length("html") >= min_revisit)
    several = long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    several = several.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(several, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """The captures written, as rows (key, page_id, url, archive, offset, length)."""
    return cut(with_decisions(pages).mapInArrow(_write(folder), CAPTURE), "captures")


SHARD = "shard string, first string, last string, directory long, blocks long, captures long"


def _line(row: dict) -> bytes:
    clean = lambda x: "" if x is None else str(x).replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")
    return "\t".join([clean(row["key"]), clean(row["page_id"]), clean(row["archive"]), str(row["offset"]), str(row["length"])]).encode()


def _index(folder: str):
    """Sorted captures to one shard: blocks, then the directory, which starts at ``directory``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, lines, entries, first, last, total = None, [], [], None, None, 0

        def flush() -> None:
            at, size = writer.put(gzip.compress(b"\n".join(lines), 6, mtime=0))
            entries.append(lines[0].split(b"\t", 1)[0] + f"\t{at}\t{size}".encode())
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                writer = writer or _Writer(folder, ".idx")
                lines.append(_line(row))
                last = lines[-1].split(b"\t", 1)[0].decode()
                first = last if first is None else first
                total += 1
                if len(lines) == BLOCK:
                    flush()
        if writer:
            if lines:
                flush()
            at, _ = writer.put(gzip.compress(b"\n".join(entries), 6, mtime=0))
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": writer.name, "first": first, "last": last, "directory": at, "blocks": len(entries), "captures": total}])

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """The index's shards (shard, first, last, directory, blocks, captures), in the order of keys."""
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("key", "%", "%25"), "\t", "%09"), "\n", "%0A"), "\r", "%0D")
    dealt = captures.withColumn("order", key).repartitionByRange(shuffle_width(captures.sparkSession), "order", "page_id")
    shards = dealt.sortWithinPartitions("order", "page_id", "archive", "offset").drop("order").mapInArrow(_index(folder), SHARD)
    return cut(shards, "shards")


class Shard:
    """A shard of the index, opened for lookups."""

    def __init__(self, folder: str, name: str, directory: int) -> None:
        self.system, path = _opened(folder)
        self.file = self.system.open_input_file(f"{path}/{name}")
        raw = gzip.decompress(self.file.read_at(self.file.size() - directory, directory))
        entries = [e.split(b"\t") for e in raw.split(b"\n")]
        self.firsts, self.ranges, self.held = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries], (-1, [], [])

    def block(self, i: int) -> tuple[list[bytes], list[list[bytes]]]:
        if self.held[0] != i:
            at, size = self.ranges[i]
            lines = [x.split(b"\t") for x in gzip.decompress(self.file.read_at(size, at)).split(b"\n")]
            self.held = (i, [x[0] for x in lines], lines)
        return self.held[1], self.held[2]

    def find(self, key: bytes) -> Iterator[list[bytes]]:
        """All captures of a key: from the last block that may begin before it on, while blocks go on with it."""
        i = max(bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.firsts) and (self.firsts[i] <= key):
            keys, lines = self.block(i)
            a, b = bisect_left(keys, key), bisect_right(keys, key)
            yield from lines[a:b]
            if b < len(keys):
                return
            i += 1

    def close(self) -> None:
        self.file.close()


FOUND = "key string, page_id long, archive string, offset long, length long"


def _lookup(folder: str):
    """Rows (shard, directory, key) sorted by shard and key to the captures found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            out = []
            for s, directory, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != name:
                    if shard:
                        shard.close()
                    shard, name = Shard(folder, s, directory), s
                out += [(key, int(x[1]) if x[1] else None, x[2].decode(), int(x[3]), int(x[4])) for x in shard.find(key.encode())]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])
        if shard:
            shard.close()

    return run


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures (key, page_id, archive, offset, length) of the distinct keys of column ``key``."""
    route = shards.collect()  # one row a shard, as many as index tasks
    sized = sorted((r["first"].encode(), r["last"].encode(), r["shard"], r["directory"]) for r in route)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("key", "%", "%25"), "\t", "%09"), "\n", "%0A"), "\r", "%0D")
    wanted = keys.select(clean.alias("key")).distinct()
    if not sized:
        return keys.sparkSession.createDataFrame([], FOUND)
    firsts, lasts = [f.decode() for f, *_ in sized], [t.decode() for _, t, *_ in sized]
    # the shards that may hold a key are consecutive: from the first that ends at it or later to the last that begins at it or earlier
    low, high = _count_below(F.col("key"), lasts, strict=True), _count_below(F.col("key"), firsts, strict=False) - 1
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    names = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(d).cast("long").alias("directory")) for *_, s, d in sized])
    dealt = wanted.select("key", F.explode(places).alias("place")).select(F.element_at(names, F.col("place") + 1).alias("at"), "key")
    dealt = dealt.select("at.shard", "at.directory", "key").repartition("shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(_lookup(folder), FOUND)


def _count_below(x, bounds: list[str], strict: bool):
    """How many of the ascending bounds are below x (or equal, if not strict), as a balanced tree of comparisons."""

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when((x > bounds[mid]) if strict else (x >= bounds[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(bounds))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str):
    """Rows (archive, offset, length) sorted by archive and offset to records, by ranges that lie near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            out, i = [], 0
            while i < len(rows):
                j, end = i, rows[i][1] + rows[i][2]
                while j + 1 < len(rows) and rows[j + 1][0] == rows[i][0] and rows[j + 1][1] - end <= NEAR and end - rows[i][1] < 1 << 22:
                    j += 1
                    end = rows[j][1] + rows[j][2]
                if rows[i][0] != name:
                    if file:
                        file.close()
                    name, file = rows[i][0], system.open_input_file(f"{path}/{rows[i][0]}")
                data, base = file.read_at(end - rows[i][1], rows[i][1]), rows[i][1]
                out += [parse(data[at - base : at - base + size]) for _, at, size in rows[i : j + 1]]
                i = j + 1
            schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file:
            file.close()

    return run


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at (archive, offset, length), in tasks that each read stretches of few archives in order."""
    rows = captures.select("archive", "offset", "length")
    rows = rows.repartitionByRange(shuffle_width(captures.sparkSession), "archive", "offset").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(_read(folder), RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every URL up in the index, and read the records found."""
    folder = fresh_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    shards = build_index(captures, folder)
    return read_records(cut(lookup(captures, shards, folder), "found"), folder)
