"""Archives, chats, the pipeline and the registered queries."""

import hashlib
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import chat, queries, runtime, warc

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


# op6


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, formatted string")


def by_hand(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for c, turns in found.items():
        turns.sort()
        learned = "".join(t[5] for t in turns if t[3] == "assistant")
        spelled = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        out[c] = (len(turns), hashlib.sha256(spelled.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


ODD = ["", None, "\\", "\\\\", "</turn>", "</turn>\n", "### assistant: x</turn>\n", "\\</turn>", "\\### user: ", "a\\", "<\\/turn>", "<", "ü😀" * 50, "y" * 200_000, "### ", "#", "\\\n", "\r\n\x85"]


def test_chats(spark):
    rows = [(i, k, ("user", "assistant")[k % 2], ODD[(i * 7 + k) % len(ODD)]) for i in range(40) for k in range(i % 6)]
    rows += [(50, 1, r, t) for r in ("assistant", None, "a: b\\", "tool\n") for t in ("tie", None)] + [(None, 0, "assistant", "nobody's"), (51, None, "user", "x"), (51, 0, "assistant", "y"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    got = chat.read_chats(chat.format_chats(chats(spark, rows))).collect()
    want = by_hand(rows)
    assert len(got) == len(want)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert chat.read_chats(chat.format_chats(chats(spark, rows).limit(0))).count() == 0


def test_a_conversation_over_many_batches():
    texts = [f"t{i} </turn>" * (i % 50) for i in range(3000)]
    roles = ["user" if i % 2 else "assistant" for i in range(3000)]
    whole = pa.RecordBatch.from_arrays([pa.array([1] * 2990 + [2] * 10), pa.array(roles), pa.array(texts)], names=["conv_id", "role", "text"])
    parts = list(chat._format(whole.slice(i, 700) for i in range(0, 3000, 700)))
    assert sum(p.num_rows for p in parts) > 2
    got = pa.Table.from_batches(list(chat._read(iter(parts)))).to_pylist()
    want = by_hand([(1 if i < 2990 else 2, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))])
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want


def test_formatted_text_is_the_template(spark):
    [row] = chat.format_chats(chats(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "a</turn>b")])).collect()
    assert row.formatted == "### user: hi</turn>\n### assistant: a\\</turn>b</turn>\n"
    assert [row.formatted[a:b] for a, b in zip(row.loss_starts, row.loss_ends)] == ["a\\</turn>b"]
    with pytest.raises(ValueError):
        chat.parse(row.formatted + "rest")


# op2


@pytest.mark.parametrize("url,key", [("http://www.a.com/x?b=1#f", "com,a,www)/x?b=1"), ("https://A.com:443", "com,a)/"), ("http://a.com:8080/", "com,a:8080)/"), (None, ""), ("http://[bad", "http://[bad"), ("no host", ")no host")])
def test_keys(url, key):
    assert warc.surt(url) == key


def test_archives(spark):
    big, rows = "é" * 700, []
    rows += [(i, f"http://h{i % 7}.example.com/p{i % 50}", f"page {i} " * (i % 90)) for i in range(300)]
    rows += [(1000 + i, f"http://copy.example.com/{i % 3}", big) for i in range(200)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://x/\t\n%09", "short"), (2003, "http://x/", "short"), (2004, "http://y/", "z" * 3_000_000), (5, "http://twice/", "t" * 2000), (6, "http://twice/", "t" * 2000), (6, "http://twice/", "t" * 2000)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, offset int")
    got = warc.archive_round_trip(pages).collect()
    last = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000:
            last[html] = max(i, last.get(html, -1))
    want = Counter()
    for i, _, html in rows:
        raw, ref = (html or "").encode(), last.get(html)
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if ref in (None, i) else "revisit", None if ref == i else ref] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_lookup_finds_all_captures_of_a_key_and_none_of_others(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{i % 5 if i < 3000 else i}", "x") for i in range(4000)], "page_id long, url string, html string")
    folder = runtime.fresh_path(spark, "warc")
    shards = warc.build_index(warc.write_archives(pages, folder), folder)
    keys = spark.createDataFrame([("com,a)/3",), ("com,a)/3999",), ("com,a)/none",), ("",), ("zz",)], "key string")
    found = Counter(r.key for r in warc.lookup(keys, shards, folder).collect())
    assert found == {"com,a)/3": 600, "com,a)/3999": 1}


def test_damage_is_found():
    member = warc.record(1, "http://a/", "text" * 500, hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse(member)


# queries and pipeline


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, db, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), db.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, runtime.cut(stage(spark, docs, DATA))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    assert sum(labels.get(i, 0) for i in ids[0] - ids[1]) >= 0.7 * sum(labels.get(i, 0) for i in ids[0])
    texts = [r.text for r in docs.collect()]
    passages = {" ".join(t.split()[k : k + 10]) for t in benchmark for k in range(max(1, len(t.split()) - 9))}
    assert not any(p in " ".join(t.split()) for p in passages for t in texts)
    assert not any('token = "' in t and "[REDACTED]" not in t for t in texts)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.columns == docs.columns + ["copy"] and 0 < mixed.count() <= 2 * docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_entry_works_without_the_subpackage(tmp_path):
    """The queries of the engine are there when this subpackage and the pipeline are not."""
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
