"""Every query of the time-series engine by name, with its SQL. Each is a function of (spark, sf_dir) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import deltas, frames
from tidemark.model import Matcher, labels_from_entries, labels_str
from tidemark.operators import blocks, chunks, head, index, select
from tidemark.operators.querier import Querier
from tidemark.sources import tables

MINT, MAXT = 1704844800000, 1705708800000  # 2024-01-10 and 2024-01-20, UTC
FIRST, LAST = 852076800000, 899251200000  # 1997-01-01 and 1998-07-01, UTC
WEEK = 604_800_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _WITH + sql
        return f

    return put


_WITH = """
WITH e AS (SELECT '__name__=event_value,event_type=' || event_type || ',user_id=' || user_id AS labels_str, 'event_value' AS name, event_type,
                  user_id::VARCHAR AS user_id, epoch_us(ts) // 1000 AS t, value AS v, event_id AS arrival FROM events),
o AS (SELECT '__name__=order_total,priority=' || o_orderpriority || ',status=' || o_orderstatus AS labels_str, o_orderstatus AS status, o_orderpriority AS priority,
             epoch_us(o_orderdate) // 1000 AS t, o_totalprice AS v, o_orderkey AS arrival FROM orders),
u AS (SELECT labels_str, 'event_value' AS name, event_type, user_id, NULL AS status, NULL AS priority, t, v, arrival FROM e
      UNION ALL SELECT labels_str, 'order_total', NULL, NULL, status, priority, t, v, arrival FROM o),
li AS (SELECT '__name__=line_quantity,linestatus=' || l_linestatus || ',returnflag=' || l_returnflag AS labels_str, epoch_us(l_shipdate) // 1000 AS t, l_quantity AS v, * FROM lineitem),
p AS (SELECT DISTINCT labels_str, unnest(['__name__', 'event_type', 'user_id', 'priority', 'status']) AS name, unnest([name, event_type, user_id, priority, status]) AS value FROM u),
post AS (SELECT * FROM p WHERE value IS NOT NULL)
"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(labels_str(F.col("labels")).alias("labels_str"), "t", "v")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Matcher.equal("__name__", "event_value"), Matcher.equal("event_type", "click")]
    return _shown(select.select_samples(tables.events(spark, sf_dir), wanted, MINT, MAXT))


def _matched(name: str, source, where: str, table: str, *matchers: Matcher, mint=None, maxt=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(select.select_samples(source(spark, sf_dir), matchers, mint, maxt))

    run.__name__ = name
    query(f"SELECT labels_str, t, v FROM {table} WHERE {where}")(run)


_matched("match_eq", tables.events, "event_type = 'click'", "e", Matcher.equal("event_type", "click"))
_matched("match_neq", tables.events, "event_type <> 'click'", "e", Matcher.not_equal("event_type", "click"))
_matched("match_eq_empty", tables.mixed, "coalesce(status, '') = ''", "u", Matcher.equal("status", ""))
_matched("match_neq_empty", tables.mixed, "coalesce(status, '') <> ''", "u", Matcher.not_equal("status", ""))
_matched("match_re", tables.events, "regexp_full_match(event_type, 'c.*|view')", "e", Matcher.regex("event_type", "c.*|view"))
_matched("match_nre", tables.events, "NOT regexp_full_match(event_type, 'c.*|view')", "e", Matcher.not_regex("event_type", "c.*|view"))
_matched("match_re_empty", tables.mixed, "regexp_full_match(coalesce(status, ''), 'F|')", "u", Matcher.regex("status", "F|"))
_matched("match_nre_empty", tables.mixed, "NOT regexp_full_match(coalesce(status, ''), 'F|')", "u", Matcher.not_regex("status", "F|"))
_matched(
    "match_and", tables.events, "event_type <> 'click' AND regexp_full_match(user_id, '1.*')", "e",
    Matcher.equal("__name__", "event_value"), Matcher.not_equal("event_type", "click"), Matcher.regex("user_id", "1.*"),
)
_matched("time_range", tables.events, f"event_type = 'click' AND t BETWEEN {MINT} AND {MAXT}", "e", Matcher.equal("event_type", "click"), mint=MINT, maxt=MAXT)


@query("SELECT labels_str, t, v FROM u WHERE status = 'F'")
def query_pair(spark, sf_dir):
    return _shown(select.query_pair(tables.mixed(spark, sf_dir), "status", "F"))


@query("SELECT name || '=' || coalesce(value, '') AS pair, count(DISTINCT labels_str) AS series FROM p WHERE name IN ('status', 'user_id') GROUP BY 1")
def label_projection(spark, sf_dir):
    """Values by name, with the empty string where a series lacks the label."""
    of = index.series(tables.mixed(spark, sf_dir))
    pairs = F.array(*[F.concat(F.lit(f"{n}="), F.coalesce(F.col("labels")[n], F.lit(""))) for n in ("status", "user_id")])
    return of.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("series"))


@query("SELECT DISTINCT 'event_type=' || event_type || ',type=last' AS labels_str FROM e")
def labels_canonical(spark, sf_dir):
    """Of equal names the last stays; entries sort by name."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    built = labels_from_entries(F.array(entry("type", F.lit("first")), entry("event_type", F.col("event_type")), entry("type", F.lit("last"))))
    return rows.select(labels_str(built).alias("labels_str"))


@query("SELECT DISTINCT name FROM post")
def label_names(spark, sf_dir):
    return index.label_names(index.series(tables.mixed(spark, sf_dir)))


@query("SELECT DISTINCT value FROM post WHERE name = 'event_type'")
def label_values(spark, sf_dir):
    return index.label_values(index.series(tables.mixed(spark, sf_dir)), "event_type")


@query("SELECT name AS symbol FROM post UNION SELECT value FROM post UNION SELECT ''")
def symbols(spark, sf_dir):
    return index.symbols(index.series(tables.mixed(spark, sf_dir)))


def _series(rows: DataFrame) -> DataFrame:
    return rows.select(labels_str(F.map_from_entries("series_key")).alias("labels_str"))


@query("SELECT name, value, labels_str FROM post")
def postings(spark, sf_dir):
    rows = index.postings(index.series(tables.mixed(spark, sf_dir)))
    return rows.select("name", "value", labels_str(F.map_from_entries("series_key")).alias("labels_str"))


@query("SELECT name, value, count(*) AS series FROM post GROUP BY ALL")
def posting_list_sizes(spark, sf_dir):
    return index.posting_lists(index.series(tables.mixed(spark, sf_dir))).select("name", "value", F.size("series").cast("long").alias("series"))


@query("SELECT labels_str FROM post WHERE name = 'event_type' AND value = 'click'")
def posting_lookup(spark, sf_dir):
    return _series(index.lookup(index.series(tables.mixed(spark, sf_dir)), "event_type", "click"))


@query("SELECT DISTINCT labels_str FROM post WHERE name = 'status'")
def postings_for_name(spark, sf_dir):
    return _series(index.for_name(index.series(tables.mixed(spark, sf_dir)), "status"))


@query("SELECT DISTINCT labels_str FROM post")
def all_postings(spark, sf_dir):
    return _series(index.all_series(index.series(tables.mixed(spark, sf_dir))))


@query("SELECT labels_str FROM post WHERE name = 'event_type' AND value = 'click' INTERSECT SELECT labels_str FROM post WHERE name = 'user_id' AND value LIKE '1%'")
def postings_intersect(spark, sf_dir):
    of = index.series(tables.mixed(spark, sf_dir))
    return _series(index.intersect(index.lookup(of, "event_type", "click"), index.for_matcher(of, Matcher.regex("user_id", "1.*"))))


@query("SELECT labels_str FROM post EXCEPT SELECT labels_str FROM post WHERE name = 'event_type' AND value = 'click'")
def postings_except(spark, sf_dir):
    of = index.series(tables.mixed(spark, sf_dir))
    return _series(index.subtract(of, index.lookup(of, "event_type", "click")))


@query("SELECT labels_str FROM post WHERE name = 'status' AND value = 'F' UNION SELECT labels_str FROM post WHERE name = 'event_type' AND value = 'view'")
def postings_union(spark, sf_dir):
    of = index.series(tables.mixed(spark, sf_dir))
    return _series(index.union(index.lookup(of, "status", "F"), index.lookup(of, "event_type", "view")))


@query("SELECT labels_str, row_number() OVER (ORDER BY min(arrival)) AS ref FROM e GROUP BY labels_str")
def series_refs(spark, sf_dir):
    return head.series_refs(tables.events(spark, sf_dir)).select(labels_str(F.col("labels")).alias("labels_str"), "ref")


_JUDGED = """, j AS (SELECT *, coalesce(t >= max(t) OVER (PARTITION BY labels_str ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM o)
"""


@query(_JUDGED + "SELECT labels_str, t, v, arrival FROM j WHERE ok")
def ooo_accepted(spark, sf_dir):
    return head.accepted(tables.orders(spark, sf_dir)).select(labels_str(F.col("labels")).alias("labels_str"), "t", "v", "arrival")


@query(_JUDGED + "SELECT labels_str, t, v, arrival FROM j WHERE NOT ok")
def ooo_rejected(spark, sf_dir):
    return head.rejected(tables.orders(spark, sf_dir)).select(labels_str(F.col("labels")).alias("labels_str"), "t", "v", "arrival")


@query(_JUDGED + "SELECT labels_str, count(*) AS num_samples, max(t) AS last_t, arg_max(v, arrival) AS last_v FROM j WHERE ok GROUP BY labels_str")
def series_state(spark, sf_dir):
    state = head.series_state(head.accepted(tables.orders(spark, sf_dir)))
    return state.select(labels_str(F.col("labels")).alias("labels_str"), "num_samples", "last_t", "last_v")


@query("SELECT (SELECT count(*) FROM (SELECT labels_str FROM e WHERE arrival > 2000 EXCEPT SELECT labels_str FROM e WHERE arrival <= 2000)) AS series, (SELECT count(*) FROM e WHERE arrival > 2000) AS samples")
def pending_counters(spark, sf_dir):
    return head.pending(tables.events(spark, sf_dir), 2000)


def _weekly(spark, sf_dir) -> DataFrame:
    return tables.events(spark, sf_dir).withColumn("block_ord", F.expr(f"t div {WEEK}"))


_CHUNKS = f""", k AS (SELECT *, t // {WEEK} AS block_ord, (row_number() OVER (PARTITION BY t // {WEEK}, labels_str ORDER BY t, arrival) - 1) // 50 AS chunk_ord FROM e),
m AS (SELECT block_ord, labels_str, chunk_ord, min(t) AS min_time, max(t) AS max_time, count(*) AS n FROM k GROUP BY ALL)
"""


@query(_CHUNKS + "SELECT * FROM m")
def chunk_meta(spark, sf_dir):
    return blocks.chunk_meta(_weekly(spark, sf_dir)).select("block_ord", labels_str(F.col("labels")).alias("labels_str"), "chunk_ord", "min_time", "max_time", "n")


@query(_CHUNKS + "SELECT block_ord, min(min_time) AS min_time, max(max_time) AS max_time, sum(n)::BIGINT AS num_samples, count(DISTINCT labels_str) AS num_series, count(*) AS num_chunks FROM m GROUP BY block_ord")
def block_meta(spark, sf_dir):
    return blocks.block_meta(_weekly(spark, sf_dir))


@query(_CHUNKS + f"SELECT labels_str, block_ord, chunk_ord, k.t, k.v FROM k JOIN m USING (block_ord, labels_str, chunk_ord) WHERE event_type = 'click' AND min_time <= {MAXT} AND max_time >= {MINT}")
def select_chunks(spark, sf_dir):
    """Whole chunks that overlap the range: samples outside it come with them."""
    found = select.select_chunks(blocks.chunks(_weekly(spark, sf_dir)), [Matcher.equal("event_type", "click")], MINT, MAXT)
    return found.select(labels_str(F.col("labels")).alias("labels_str"), "block_ord", "chunk_ord", F.explode("samples").alias("s")).select("labels_str", "block_ord", "chunk_ord", "s.t", "s.v")


@query(_CHUNKS + f"SELECT block_ord, count(*) AS chunks, sum(n)::BIGINT AS samples FROM m WHERE block_ord IN (SELECT block_ord FROM m GROUP BY 1 HAVING min(min_time) <= {MAXT} AND max(max_time) >= {MINT}) AND min_time <= {MAXT} AND max_time >= {MINT} AND labels_str LIKE '%event_type=view%' GROUP BY 1")
def select_block_pruned(spark, sf_dir):
    """Blocks are left out by their metadata before their chunks are looked at."""
    samples = _weekly(spark, sf_dir)
    live = [r["block_ord"] for r in select.overlapping(blocks.block_meta(samples), MINT, MAXT).collect()]  # one row a block
    kept = blocks.chunk_meta(samples.where(F.col("block_ord").isin(live)))
    return select.select_chunks(kept, [Matcher.equal("event_type", "view")], MINT, MAXT).groupBy("block_ord").agg(F.count("*").alias("chunks"), F.sum("n").alias("samples"))


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A block of what came by 2024-01-15 and a head of the rest, one chunk relation each."""
    border = 1705276800000
    samples = tables.events(spark, sf_dir).withColumn("block_ord", F.lit(0))
    return blocks.chunks(samples.where(F.col("t") < border)), blocks.chunks(samples.where(F.col("t") >= border))


_SPLIT = f""", s AS (SELECT *, (t >= 1705276800000)::INT AS src FROM e),
k AS (SELECT *, (row_number() OVER (PARTITION BY src, labels_str ORDER BY t, arrival) - 1) // 50 AS chunk_ord FROM s),
m AS (SELECT src, labels_str, chunk_ord, min(t) AS min_time, max(t) AS max_time FROM k GROUP BY ALL HAVING min(t) <= {MAXT} AND max(t) >= {MINT})
"""


@query(f"SELECT labels_str, t, v FROM e WHERE event_type = 'purchase' AND t BETWEEN {MINT} AND {MAXT}")
def querier_merge(spark, sf_dir):
    """Samples of block and head together."""
    block, live = _split(spark, sf_dir)
    return _shown(Querier([block, None], [live]).samples([Matcher.equal("event_type", "purchase")], MINT, MAXT))


@query(_SPLIT + "SELECT labels_str, row_number() OVER (PARTITION BY labels_str ORDER BY min_time, max_time, src, chunk_ord) - 1 AS pos, min_time, max_time FROM m WHERE labels_str LIKE '%event_type=purchase%'")
def querier_chunks_sorted(spark, sf_dir):
    block, live = _split(spark, sf_dir)
    found = Querier([block], [live]).select([Matcher.equal("event_type", "purchase")], MINT, MAXT)
    rows = found.select(labels_str(F.col("labels")).alias("labels_str"), F.posexplode("chunks").alias("pos", "c"))
    return rows.select("labels_str", F.col("pos").cast("long").alias("pos"), "c.min_time", "c.max_time")


@query("SELECT labels_str, t, v FROM (SELECT *, arrival % 3 AS block_ord, row_number() OVER (PARTITION BY labels_str, t ORDER BY arrival % 3 DESC, arrival DESC) AS k FROM o) WHERE k = 1")
def compact_dedup(spark, sf_dir):
    return _shown(blocks.compacted(tables.orders(spark, sf_dir).withColumn("block_ord", F.col("arrival") % 3)))


@query("SELECT labels_str, t, v FROM (SELECT *, row_number() OVER (PARTITION BY labels_str, t ORDER BY l_orderkey % 3 DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM li) WHERE k = 1")
def compact_many_ties(spark, sf_dir):
    return _shown(blocks.compacted(tables.lineitem(spark, sf_dir).withColumn("block_ord", F.col("arrival.l_orderkey") % 3)))


@query(", b AS (SELECT DISTINCT arrival % 3 AS block_ord FROM o) SELECT (max(block_ord) + 2)::BIGINT AS level, string_agg('B' || block_ord, ',' ORDER BY block_ord) AS sources FROM b")
def compact_meta(spark, sf_dir):
    ords = tables.orders(spark, sf_dir).select((F.col("arrival") % 3).alias("block_ord")).distinct()
    metas = ords.select((F.col("block_ord") + 1).alias("level"), F.array(F.concat(F.lit("B"), F.col("block_ord").cast("string"))).alias("sources"))
    return blocks.compacted_meta(metas).select("level", F.array_join("sources", ",").alias("sources"))


_DOD = """, d AS (SELECT *, t - lag(t) OVER (PARTITION BY labels_str ORDER BY t, arrival) AS delta FROM e),
dd AS (SELECT *, delta - lag(delta) OVER (PARTITION BY labels_str ORDER BY t, arrival) AS dod FROM d)
"""


@query(_DOD + "SELECT labels_str, t, arrival, delta, dod FROM dd")
def delta_of_delta(spark, sf_dir):
    return deltas.delta_of_delta(tables.events(spark, sf_dir)).select(labels_str(F.col("labels")).alias("labels_str"), "t", "arrival", "delta", "dod")


@query(_DOD + "SELECT CASE WHEN dod = 0 THEN 0 WHEN dod BETWEEN -8191 AND 8192 THEN 14 WHEN dod BETWEEN -65535 AND 65536 THEN 17 WHEN dod BETWEEN -524287 AND 524288 THEN 20 ELSE 64 END AS width, count(*) AS samples FROM dd WHERE dod IS NOT NULL GROUP BY 1")
def dod_bucket(spark, sf_dir):
    rows = deltas.delta_of_delta(tables.events(spark, sf_dir)).where("dod is not null")
    return rows.groupBy(deltas.encoded_width(F.col("dod")).alias("width")).agg(F.count("*").alias("samples"))


@query("SELECT arrival // 1000 AS seq, arrival % 1000 AS off, ((arrival // 1000) << 32) | (arrival % 1000) AS ref FROM e")
def chunk_refs(spark, sf_dir):
    """Packed references and their parts again."""
    refs = tables.events(spark, sf_dir).select(deltas.chunk_ref(F.expr("arrival div 1000"), F.col("arrival") % 1000).alias("ref"))
    return refs.select(deltas.chunk_ref_seq(F.col("ref")).alias("seq"), deltas.chunk_ref_offset(F.col("ref")).alias("off"), "ref")


@query()
def crc32c(spark, sf_dir):
    """Checksums of all label strings; no SQL engine at hand has this polynomial."""
    rows = tables.events(spark, sf_dir).select(labels_str(F.col("labels")).alias("labels_str")).distinct()
    return frames.crc32c(rows, "labels_str")


@query("SELECT arrival - 5000 AS x, arrival - 5000 AS decoded FROM e")
def varint(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select((F.col("arrival") - 5000).alias("x"))
    return frames.varint_round_trip(rows, "x").select("x", "decoded")


@query("SELECT t, arrival AS count, arrival % 3 AS zero_count, arrival - arrival % 3 AS first_bucket FROM e")
def histogram_roundtrip(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select("t", F.col("arrival").alias("count"), (F.col("arrival") % 3).alias("zero_count"))
    return frames.histogram_round_trip(rows)


@query("SELECT labels_str, t, v FROM e")
def xor_roundtrip(spark, sf_dir):
    encoded = chunks.encode_chunks(tables.events(spark, sf_dir), "arrival")
    return _shown(chunks.decode_chunks(encoded, "labels"))


@query("SELECT labels_str, count(*) AS samples FROM e GROUP BY 1")
def xor_sample_counts(spark, sf_dir):
    """Sample counts read from the chunks' first bytes."""
    encoded = chunks.encode_chunks(tables.events(spark, sf_dir), "arrival")
    counts = encoded.select(labels_str(F.col("labels")).alias("labels_str"), chunks.num_samples(F.col("data")).alias("n"))
    return counts.groupBy("labels_str").agg(F.sum("n").alias("samples"))


def _logged(spark, sf_dir) -> DataFrame:
    from tidemark.sources import block, wal

    block.register(spark)
    samples = head.accepted(tables.orders(spark, sf_dir))
    refs = head.series_refs(samples).withColumn("labels_str", labels_str(F.col("labels"))).select("labels_str", "ref")
    named = samples.withColumn("labels_str", labels_str(F.col("labels"))).join(refs, "labels_str")
    folder = _scratch(spark, "wal")
    wal.write_log(named, folder)
    return spark.read.format("tsdb_wal").load(folder)


def _scratch(spark: SparkSession, kind: str) -> str:
    """A folder that driver and executors share, for files of the binary formats."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/tidemark-{kind}-{uuid.uuid4().hex}"


@query(_JUDGED + "SELECT labels_str, t, v FROM j WHERE ok")
def replay_head(spark, sf_dir):
    """Accepted samples written to a log, read back and joined to their series."""
    from tidemark.sources import wal

    log = _logged(spark, sf_dir)
    rows = head.replay(wal.wal_series(log), wal.wal_samples(log))
    return rows.select(labels_str(F.col("labels")).alias("labels_str"), "t", _value(F.col("v_bits")).alias("v"))


def _value(bits):
    """The double with these bits, on the JVM: sign, exponent and fraction put together."""
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(0x7FF)
    fraction = bits.bitwiseAND((1 << 52) - 1)
    normal = (F.lit(1.0) + fraction / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), exponent - 1023)
    small = fraction / F.lit(float(1 << 52)) * F.lit(2.0**-1022)
    size = F.when(exponent == 0x7FF, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(exponent == 0, small).otherwise(normal)
    return F.when(bits < 0, -size).otherwise(size)


@query("SELECT labels_str, t, v FROM e")
def block_roundtrip(spark, sf_dir):
    """All events as a binary block, written and scanned."""
    from tidemark.sources import block

    block.register(spark)
    parent = _scratch(spark, "block")
    ulid = block.export_block(chunks.encode_chunks(tables.events(spark, sf_dir), "arrival"), parent)
    return _shown(chunks.decode_chunks(select.xor_only(spark.read.format("tsdb_block").load(f"{parent}/{ulid}")), "labels"))


@query(f"SELECT labels_str, t, v FROM o WHERE priority <> '5-LOW' AND status <> 'P' AND regexp_full_match(priority, '[1-3].*') AND t BETWEEN {FIRST} AND {LAST}")
def block_select(spark, sf_dir):
    """Matchers and a range on a binary block: postings choose the series, then only their overlapping chunks are read."""
    from tidemark.sources import block

    parent = _scratch(spark, "select")
    block.register(spark)
    ulid = block.export_block(chunks.encode_chunks(tables.orders(spark, sf_dir), "arrival"), parent)
    wanted = [Matcher.not_equal("priority", "5-LOW"), Matcher.not_regex("status", "P|X"), Matcher.regex("priority", "[1-3].*"), Matcher.equal("absent", "")]
    found = chunks.decode_chunks(select.xor_only(block.select_block(spark, f"{parent}/{ulid}", wanted, FIRST, LAST)), "labels")
    return _shown(found.where(F.col("t").between(FIRST, LAST)))


@query(_JUDGED + "SELECT labels_str, t, v FROM j WHERE ok")
def head_flush(spark, sf_dir):
    """A head's chunks written as a block, their bytes as they are, and read back."""
    from tidemark.sources import block

    block.register(spark)
    parent = _scratch(spark, "flush")
    ulid = block.export_block(chunks.encode_chunks(head.accepted(tables.orders(spark, sf_dir)), "arrival"), parent)
    return _shown(chunks.decode_chunks(spark.read.format("tsdb_block").load(f"{parent}/{ulid}"), "labels"))


@query("SELECT labels_str, ref FROM (SELECT labels_str, row_number() OVER (ORDER BY min(arrival)) AS ref FROM o GROUP BY labels_str) WHERE ref = 3")
def ref_lookup(spark, sf_dir):
    """The series of one reference."""
    refs = head.series_refs(tables.orders(spark, sf_dir))
    return head.lookup(refs, 3).select(labels_str(F.col("labels")).alias("labels_str"), "ref")


@query("SELECT labels_str, t, v FROM (SELECT *, row_number() OVER (PARTITION BY labels_str, t ORDER BY arrival % 2 DESC, arrival DESC) AS k FROM o) WHERE k = 1")
def compact_binary(spark, sf_dir):
    """Two overlapping binary blocks compacted to a third: the later block's sample stays."""
    from tidemark.sources import block

    block.register(spark)
    parent = _scratch(spark, "compact")
    samples = tables.orders(spark, sf_dir)
    parts = [f"{parent}/{block.export_block(chunks.encode_chunks(samples.where(F.col('arrival') % 2 == i), 'arrival'), parent)}" for i in (0, 1)]
    ulid = block.compact(spark, parent, parts)
    return _shown(chunks.decode_chunks(spark.read.format("tsdb_block").load(f"{parent}/{ulid}"), "labels"))


@query(f"SELECT labels_str, t, v FROM e WHERE event_type = 'click' AND t BETWEEN {MINT} AND {MAXT}")
def native_store(spark, sf_dir):
    """The native layout: weekly blocks of Parquet, pruned by block and by the promoted metric."""
    from tidemark.sources import store

    path = _scratch(spark, "store")
    path = path if "://" in path else f"file://{path}"
    store.write_blocks(_weekly(spark, sf_dir), path)
    return _shown(store.scan(spark, path, [Matcher.equal("__name__", "event_value"), Matcher.equal("event_type", "click")], MINT, MAXT))


@query(_JUDGED + "SELECT labels_str, t, v, arrival, ok AS accepted FROM j")
def streaming_head(spark, sf_dir):
    """The orders as a stream: keyed state decides what is in order, as the batch rule does."""
    from tidemark.streaming import head as live

    path, out = _scratch(spark, "stream"), _scratch(spark, "out")
    path, out = (p if "://" in p else f"file://{p}" for p in (path, out))
    samples = tables.orders(spark, sf_dir)
    samples.write.parquet(f"{path}/in")  # in parts: one micro-batch takes all of them, and each series by arrival
    stream = spark.readStream.schema(samples.schema).parquet(f"{path}/in")
    run = live.ingest(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(live.OUT).parquet(out)
