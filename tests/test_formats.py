import random

import pytest

from tidemark.errors import TsdbError
from tidemark.functions import xor
from tidemark.sources import block, files, wal


def test_frame_of_a_small_record():
    framed = wal.frame(0, b"hello")
    assert framed[:3].hex() == "010005" and framed[3:7].hex() == "9a71bb4c" and framed[7:] == b"hello"
    assert list(wal.records(wal.frame(0, b""))) == [b""]


def log_of(bodies):
    data = bytearray()
    for b in bodies:
        data += wal.frame(len(data), b)
    return bytes(data)


def test_frames_round_trip():
    rng = random.Random(3)
    bodies = [rng.randbytes(rng.choice((0, 1, 100, 32_760, 32_761, 32_762, 70_000))) for _ in range(60)]
    assert list(wal.records(log_of(bodies))) == bodies
    assert list(wal.records(log_of(bodies) + wal.closing_pad(len(log_of(bodies))))) == bodies


@pytest.mark.parametrize("cut", [1, 5, 400, 33_000])
def test_torn_tail(cut):
    data = log_of([b"first", bytes([1]) * 40_000])
    torn = data[:-cut]
    assert list(wal.records(torn, last_segment=True)) == [b"first"]
    with pytest.raises(TsdbError):
        list(wal.records(torn, last_segment=False))


def test_damage_is_an_error():
    data = bytearray(log_of([b"first", b"second"]))
    for at, mask in ((9, 1), (0, 0x08), (0, 0x10), (4, 1)):
        bad = bytearray(data)
        bad[at] ^= mask
        with pytest.raises(TsdbError):
            list(wal.records(bytes(bad)))
    with pytest.raises(TsdbError):
        list(wal.records(bytes(data) + b"\x00\x00\x07"))


def test_series_records():
    entries = [(1, {"__name__": "up", "job": "api"}), (2, {}), (1 << 40, {"k": "ü"})]
    assert list(wal.decode_series(wal.encode_series(entries))) == entries
    assert wal.encode_series([]) == b"\x01"


def test_sample_records():
    # every change between no start time, the same one and another one, with refs and times that go up and down
    starts = [0, 0, 40, 40, 9, 0, 9, 9, 0, 40]
    rows = [(7 + (3 * i) % 5, 90_000 - 777 * i * (-1) ** i, st, (1 << 52) + i) for i, st in enumerate(starts)]
    assert list(wal.decode_samples(wal.encode_samples(rows))) == rows
    assert list(wal.decode_samples(wal.encode_samples([]))) == []
    raw = bytearray(wal.encode_samples([(1, 1, 0, 0), (1, 2, 0, 0)]))
    raw[-9] = 7
    with pytest.raises(TsdbError) as e:
        list(wal.decode_samples(bytes(raw)))
    assert e.value.code == "st_marker_invalid"
    with pytest.raises(TsdbError):
        list(wal.decode_series(wal.encode_samples(rows)))


def test_segments_roll_and_resume(tmp_path):
    folder = str(tmp_path / "wal")
    w = wal.SegmentWriter(folder, limit=100_000)
    for i in range(10):
        w.log(bytes([11]) + bytes(30_000))
    w.close()
    first = files.numbered(folder, 8)
    assert len(first) > 2
    with pytest.raises(TsdbError):
        w.log(b"x")
    (tmp_path / "wal" / "junk").write_text("x")
    wal.SegmentWriter(folder).close()
    assert len(files.numbered(folder, 8)) == len(first) + 1
    with pytest.raises(TsdbError):
        files.numbered(str(tmp_path / "none"), 8)


def test_wal_source(spark, tmp_path):
    block.register(spark)
    folder = str(tmp_path / "wal")
    w = wal.SegmentWriter(folder)
    w.log(wal.encode_series([(1, {"a": "b"})]))
    w.cut()
    w.log(wal.encode_samples([(1, 5, 0, xor.bits_of(2.5))]))
    w.log(b"\x03rest")
    w.close()
    log = spark.read.format("tsdb_wal").load(folder)
    assert [(r.segment, r.rec_type) for r in log.orderBy("segment", "rec_ord").collect()] == [(0, 1), (1, 11), (1, 3)]
    assert [(r.ref, r.labels) for r in wal.wal_series(log).collect()] == [(1, {"a": "b"})]
    assert [(r.ref, r.t, r.v_bits) for r in wal.wal_samples(log).collect()] == [(1, 5, xor.bits_of(2.5))]
    assert [(r.rec_type, r.records) for r in wal.skipped(log).collect()] == [(3, 1)]


def some_series():
    chunk = lambda rows: (rows[0][0], rows[-1][0], xor.encode([(t, xor.bits_of(v)) for t, v in rows]))
    return [
        ({"__name__": "up", "job": "api"}, [chunk([(0, 1.0), (30, 1.0)]), chunk([(100, 1.0), (200, 1.0)])]),
        ({"__name__": "up", "job": "web"}, [chunk([(0, 0.0), (200, 1.0)])]),
        ({"__name__": "none"}, []),
    ]


def test_block_round_trip(tmp_path):
    ulid = block.write_block(str(tmp_path), some_series())
    folder = f"{tmp_path}/{ulid}"
    b = block.Block(folder)
    assert b.meta.stats == {"num_samples": 6, "num_series": 2, "num_chunks": 3} and (b.meta.min_time, b.meta.max_time) == (0, 200)
    assert b.meta.sources == [ulid] and b.meta.level == 1
    assert b.index.label_values("job") == ["api", "web"] and list(b.index.symbols.values()) == ["", "__name__", "api", "job", "up", "web"]
    assert b.index.postings("job", "api") + b.index.postings("job", "web") == b.index.postings("__name__", "up") == b.index.all_postings() == b.index.postings_for_name("job")
    assert b.index.postings("job", "nope") == []
    [(labels, data)] = b.query("job", "api")
    assert labels == {"__name__": "up", "job": "api"} and len(data) == 2
    segment = files.read_bytes(f"{folder}/chunks/000001")
    assert [x[0] for x in block.iterate_segment(segment)] == sorted(m.ref & 0xFFFFFFFF for i in b.index.all_postings() for m in b.index.series(i)[1])
    with pytest.raises(TsdbError):
        block.ChunkWriter(f"{folder}/chunks")


def test_block_damage(tmp_path):
    folder = f"{tmp_path}/{block.write_block(str(tmp_path), some_series())}"
    data = bytearray(files.read_bytes(f"{folder}/index"))
    for at in (0, len(data) - 1, 12):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        with pytest.raises(TsdbError):
            block.Index(bytes(bad))
    data[4] = 9
    with pytest.raises(TsdbError) as e:
        block.Index(bytes(data))
    assert e.value.code == "not_supported"
    path = tmp_path / folder.split("/")[-1] / "chunks" / "000001"
    raw = bytearray(path.read_bytes())
    raw[12] ^= 1
    path.write_bytes(raw)
    ref = block.Block(folder).index.series(block.Block(folder).index.all_postings()[0])[1][0].ref
    with pytest.raises(TsdbError):
        block.read_chunk(f"{folder}/chunks", ref)


def test_segments_of_a_block_roll(tmp_path):
    w = block.ChunkWriter(str(tmp_path / "c"), limit=100)
    refs = [w.write(1, bytes(40)) for _ in range(5)]
    w.close()
    assert [r >> 32 for r in refs] == [0, 1, 2, 3, 4] or len({r >> 32 for r in refs}) > 1
    assert all(block.read_chunk(str(tmp_path / "c"), r) == ("XOR", bytes(40)) for r in refs)
    with pytest.raises(TsdbError):
        block.read_chunk(str(tmp_path / "c"), 99 << 32)


def test_symbols_must_ascend():
    with pytest.raises(TsdbError):
        block.encode_index(["b", "a"], [])
    assert block.Index(block.encode_index([""], [])[0]).all_postings() == []


def test_meta():
    m = block.BlockMeta.from_json('{"version": 1, "ulid": "X", "minTime": 0, "maxTime": 7200000, "stats": {"numSamples": 102, "new": 1}, "compaction": {"level": 1, "sources": ["X"]}, "more": null}')
    assert (m.max_time, m.stats, m.sources, m.deletable) == (7200000, {"num_samples": 102}, ["X"], False)
    assert block.BlockMeta.from_json(m.to_json()) == m
    for bad in ('{"version": 2}', "[", '{"version": 1, "minTime": "x"}', "[]"):
        with pytest.raises(TsdbError) as e:
            block.BlockMeta.from_json(bad)
        assert e.value.code == "invalid_argument"


def test_block_source_and_compaction(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import chunks, select

    block.register(spark)
    encode = lambda rows: [({"k": "v"}, [(rows[0][0], rows[-1][0], xor.encode([(t, xor.bits_of(v)) for t, v in rows]))])]
    inputs = [{15 * i: float(i) for i in range(9)}, {15 * i + 60: -float(i) for i in range(9)}]  # five times are in both
    parts = [f"{tmp_path}/{block.write_block(str(tmp_path), encode(list(r.items())))}" for r in inputs]
    merged = f"{tmp_path}/{block.compact(spark, str(tmp_path), parts)}"
    rows = chunks.decode_chunks(select.xor_only(spark.read.format("tsdb_block").load(merged)), "labels").orderBy("t").collect()
    assert {r.t: r.v for r in rows} == inputs[0] | inputs[1] and len(rows) == 13
    meta = block.read_meta(merged)
    assert meta.level == 2 and meta.sources == sorted(block.read_meta(p).ulid for p in parts) and meta.stats["num_samples"] == 13
    assert spark.read.format("tsdb_block").option("mint", 500).load(merged).count() == 0
    with pytest.raises(TsdbError):
        block.compact(spark, str(tmp_path), [])
    other = spark.createDataFrame([("histogram", b"x")], "encoding string, data binary")
    with pytest.raises(Exception, match="not_supported"):
        select.xor_only(other).select(F.length("data")).collect()


def labelled_block(parent, per_series=3):
    """Series by zone and kind, some without a zone, some with an empty one; chunks of two samples, 20 ms apart."""
    named = [{k: v for k, v in (("__name__", "level"), ("zone", zone), ("kind", kind)) if v is not None} for zone in (None, "", "east", "eastern", "west") for kind in ("a", "b")]
    series = []
    for i, labels in enumerate(named):
        spans = [[(100 * i + 20 * j, xor.bits_of(float(j))), (100 * i + 20 * j + 9, xor.bits_of(-1.0))] for j in range(per_series)]
        series.append((labels, [(c[0][0], c[-1][0], xor.encode(c)) for c in spans]))
    return f"{parent}/{block.write_block(str(parent), series)}", series


def test_block_select_against_plain_rules(spark, tmp_path):
    from tidemark.model import Matcher

    folder, series = labelled_block(tmp_path)
    eq, neq, re_, nre = Matcher.equal, Matcher.not_equal, Matcher.regex, Matcher.not_regex
    for matchers in (
        [eq("zone", "east")], [eq("zone", "")], [neq("zone", "")], [neq("zone", "west"), eq("kind", "b")], [re_("zone", "east.*"), nre("kind", "a")],
        [re_("zone", "|west")], [nre("zone", ".+")], [eq("zone", "nowhere")], [neq("gone", "")], [eq("gone", ""), nre("gone", "x")], [re_("kind", r"\p{Lower}")],
    ):
        for lo, hi in ((-(1 << 60), 1 << 60), (110, 225), (829, 829), (950, 2000)):
            got = {(tuple(sorted(r.labels.items())), r.min_time, bytes(r.data)) for r in block.select_block(spark, folder, matchers, lo, hi).collect()}
            assert got == {
                (tuple(sorted(labels.items())), c[0], c[2])
                for labels, cs in series if all(m.matches(labels.get(m.name, "")) for m in matchers) for c in cs if c[0] <= hi and c[1] >= lo
            }
    with pytest.raises(TsdbError):
        block.select_block(spark, folder, [], 0, 1)


def test_only_ranges_of_chosen_series_are_read(tmp_path, monkeypatch):
    folder, series = labelled_block(tmp_path, per_series=40)
    monkeypatch.setattr(block, "RANGE_GAP", 200)
    reader = block._BlockReader({"path": folder, "pairs": '[["zone", ["east"], true]]', "chunks_per_partition": "30"})
    parts = reader.partitions()
    assert len(parts) == 3
    read, real = [], files.read_range
    monkeypatch.setattr(block.files, "read_range", lambda path, at, n: read.append(n) or real(path, at, n))
    monkeypatch.setattr(block.files, "read_bytes", lambda path: pytest.fail("a whole segment was read"))
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted(r[8] for r in rows) == sorted(c[2] for labels, cs in series if labels.get("zone") == "east" for c in cs)
    assert sum(read) < 0.5 * len(real(f"{folder}/chunks/000001", 0, 1 << 30))


def test_head_chunks_are_flushed_as_they_are(spark, tmp_path):
    from tidemark.operators import chunks

    block.register(spark)
    rows = spark.createDataFrame([({"k": str(i % 4)}, 10 * i, i / 3, i) for i in range(4000)], "labels map<string,string>, t long, v double, arrival long")
    encoded = chunks.encode_chunks(rows, "arrival")
    ulid = block.export_block(encoded, str(tmp_path))
    back = spark.read.format("tsdb_block").load(f"{tmp_path}/{ulid}")
    show = lambda df: sorted((r.labels["k"], r.chunk_ord, r.min_time, r.max_time, bytes(r.data)) for r in df.collect())
    assert show(back) == show(encoded) and len(show(back)) > 4
    assert block.read_meta(f"{tmp_path}/{ulid}").stats["num_samples"] == 4000


def test_chunks_are_streamed_to_their_segment(tmp_path):
    """Of a long series of many chunks, no more than a few are held by the writer."""
    import tracemalloc

    body = xor.encode([(0, xor.bits_of(1.0))])
    body += bytes(40_000 - len(body))

    def held(n: int) -> int:
        tracemalloc.start()
        ulid = block.write_block(str(tmp_path), [({"k": "v"}, ((i, i, body[:-2] + i.to_bytes(2, "big")) for i in range(n)))])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        index = block.Block(f"{tmp_path}/{ulid}").index
        [(_, metas)] = [index.series(r) for r in index.all_postings()]
        assert [m.min_time for m in metas] == list(range(n))
        assert all(block.read_chunk(f"{tmp_path}/{ulid}/chunks", metas[i].ref) == ("XOR", body[:-2] + i.to_bytes(2, "big")) for i in (0, n - 1))
        return most

    assert held(100) < 1_500_000  # 4 MB of chunks


def test_series_wait_in_a_file(tmp_path):
    """Of many series the writer holds their symbols and posting lists, not labels and chunks."""
    import tracemalloc

    body, n = xor.encode([(0, xor.bits_of(1.0))]), 5000
    tracemalloc.start()
    series = (({f"{k}{i % 3}": f"{i % 3}" for k in "abcdefgh"} | {"id": str(i % 10)}, [(10 * j - 50, 10 * j - 45, body) for j in range(3)]) for i in range(n))
    folder = f"{tmp_path}/{block.write_block(str(tmp_path), series)}"
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    b = block.Block(folder)
    assert most < 5_500_000, most
    assert (b.meta.min_time, b.meta.max_time, b.meta.stats) == (-50, -25, {"num_samples": 3 * n, "num_series": n, "num_chunks": 3 * n})
    found = b.index.all_postings()
    assert len(found) == n and b.index.postings("id", "7") == found[7::10]
    assert [m.min_time for m in b.index.series(found[-1])[1]] == [-50, -40, -30] and b.index.series(found[4])[0]["a1"] == "1"
