"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct shingles of ``n`` words. Sets are told apart by a 64-bit digest ("owner"), so copies
are one set from the start. All shingles have one global order: by the number of sets that hold them, then by hash;
the few very common ones (in a hundredth of all documents or so; their number depends on how long documents are, not
on how many there are) come last in the order of their sampled counts. A shingle in one set only can be in no
intersection: it counts as a position, but is never joined.

  scan        owners and sizes, and which shingles are very common
  counts      postings (shingle, owner), packed by range of hashes; sets per shingle; what two sets or more hold goes
              back to its owners
  sets        per owner its shared shingles in order, and how many of them fall into the prefix
  stars       in each prefix shingle's group, every set is paired with the group's most shared set only
  chains      twice, each group in an order of its own: every set is paired with the one before it
  rest        all pairs of one group whose sets are in different components so far
  components  over the verified pairs, after each of these steps

Stars and chains make large groups of near copies one component at a cost that is linear in the group. The pairs left
out are those inside one component, which can't change the result; every other pair that can reach the threshold is
filtered (length, position, suffix) as it is made, and verified once on the whole sets.

Defined cases: null texts, and texts without words, have an empty set and are linked with nothing; texts of fewer than
``n`` words have their whole sequence as one shingle; a null doc_id takes part, and is no component's least id unless
it has no other; repeated rows are copies; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.components import components
from tidemark.llm.runtime import bucket_count, cut, scope

U = np.uint64
#: A shingle is very common if it is in more than this part of all documents; a chunk reports at half of that.
COMMON = 0.01
#: Longs of a set's signature; parts into which a group's chain is split, so that no group is one task's.
LONGS, PARTS = 8, 16
#: Up to so many documents that go (two numbers each) are counted and then broadcast, so that texts need no shuffle.
FEW_GONE = 1 << 18


@dataclass(frozen=True)
class Threshold:
    """Similarity num / den as whole numbers: sets link when den * intersection >= num * union."""

    num: int
    den: int

    def least(self, size):
        """The least intersection that a set of this size needs with any other."""
        return -(-self.num * size // self.den)

    def overlap(self, a: Column, b: Column) -> Column:
        """The least intersection that sets of these sizes need with each other."""
        return F.ceil((a + b) * F.lit(self.num) / F.lit(self.num + self.den))

    def lengths(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def reached(self, common: Column, a: Column, b: Column) -> Column:
        return common * self.den >= (a + b - common) * self.num


def _sets(column: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct shingles, ascending, and the digests of the sets."""
    hashes, bounds = tokens.shingles(*tokens.word_hashes(column), n)
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    owners = np.array([tokens.mix(s + U(0x1234567)).sum(dtype=U) + U(len(s)) for s in sets], dtype=U)
    return sets, tokens.mix(owners)


def _scan(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.chunks(batch.column(1)):
                sets, owners = _sets(batch.column(1).slice(a, b - a), n)
                sizes = np.array([len(s) for s in sets])
                _, firsts = np.unique(owners, return_index=True)  # copies in a chunk count once
                ids, counts = np.unique(np.concatenate([sets[i] for i in firsts]), return_counts=True)
                often = counts >= max(8, COMMON / 2 * len(sets))
                report = [None] * (b - a)
                report[0] = ids[often].tobytes() + counts[often].astype(np.int64).tobytes() if often.any() else None
                owner = pa.array(owners.view(np.int64), mask=sizes == 0)
                ids = [batch.column(i).slice(a, b - a) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes), owner, pa.array(report, type=pa.binary())], names=["doc_id", "h", "n", "owner", "often"])

    return run


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [np.frombuffer(x, dtype=np.int64) for x in batch.column(0).to_pylist()]
        ids, counts = (np.concatenate([x.reshape(2, -1)[i] for x in both]) if both else np.zeros(0, dtype=np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["shingle", "sets"])


_POSTINGS = "bucket int, owners binary, sizes binary, counts binary, shingles binary, ranks binary"


def _packed(bucket: int, owner: np.ndarray, size: np.ndarray, shingle: np.ndarray, rank: np.ndarray) -> dict:
    """Rows of one bucket, sorted by owner, with each owner once."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(owner)))
    return {"bucket": int(bucket), "owners": owner[first].tobytes(), "sizes": size[first].astype(np.uint32).tobytes(), "counts": counts.astype(np.uint32).tobytes(), "shingles": shingle.tobytes(), "ranks": rank.astype(np.int64).tobytes()}


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
    counts = read("counts", np.uint32)
    return np.repeat(read("owners", U), counts), np.repeat(read("sizes", np.uint32), counts), read("shingles", U), read("ranks", np.int64)


def _split(key: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[dict]:
    order = np.argsort(key, kind="stable")
    ends = np.searchsorted(key[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        part = order[ends[k] : ends[k + 1]]
        yield _packed(k, *(c[part] for c in columns))


def _deal(n: int, buckets: int, common: np.ndarray, counts: np.ndarray):
    """Postings by hash of the shingle; very common shingles need no counting and go by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("owners", "sizes", "counts", "shingles", "ranks"))])
        for batch in batches:
            for a, b in tokens.chunks(batch.column(0)):
                sets, owners = _sets(batch.column(0).slice(a, b - a), n)
                _, firsts = np.unique(owners, return_index=True)
                sizes = np.array([len(sets[i]) for i in firsts])
                shingle = np.concatenate([sets[i] for i in firsts])
                if not len(shingle):
                    continue
                owner, size = np.repeat(owners[firsts], sizes), np.repeat(sizes, sizes)
                at = np.minimum(np.searchsorted(common, shingle), max(len(common) - 1, 0))
                often = common[at] == shingle if len(common) else np.zeros(len(shingle), dtype=bool)
                rank = np.zeros(len(shingle), dtype=np.int64)
                rank[often] = counts[at[often]] + (1 << 40) if often.any() else 0
                key = (np.where(often, owner, shingle) % U(buckets)).astype(np.int64)
                yield pa.RecordBatch.from_pylist(list(_split(key, buckets, owner, size, shingle, rank)), schema=schema)

    return run


def _count(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("owners", "sizes", "counts", "shingles", "ranks"))])
        owner, size, shingle, rank = _unpacked(table)
        order = np.lexsort((owner, shingle))
        owner, size, shingle, rank = owner[order], size[order], shingle[order], rank[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])))
        owner, size, shingle, rank = owner[new], size[new], shingle[new], rank[new]
        first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        held = np.diff(np.append(first, len(shingle)))
        held = np.repeat(held, held)
        rank = np.where(rank > 0, rank, held)
        keep = rank > 1
        order = np.lexsort((shingle[keep], owner[keep]))
        owner, size, shingle, rank = owner[keep][order], size[keep][order], shingle[keep][order], rank[keep][order]
        rows = list(_split((owner % U(buckets)).astype(np.int64), buckets, owner, size, shingle, rank))
        return pa.Table.from_pylist(rows, schema=schema)

    return run


_SETS = "owner long, n int, prefix int, shared array<long>, bits array<long>"


def _assemble(limit: Threshold):
    def run(table: pa.Table) -> pa.Table:
        owner, size, shingle, rank = _unpacked(table)
        order = np.lexsort((shingle, rank, owner))
        owner, size, shingle = owner[order], size[order], shingle[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])))  # copies in other chunks
        owner, size, shingle = owner[new], size[new].astype(np.int64), shingle[new]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        shared = np.diff(np.append(first, len(owner)))
        n = size[first]
        prefix = shared - limit.least(n) + 1  # of the n - least(n) + 1 first, those that are shared
        keep = np.flatnonzero(prefix > 0)
        held = np.repeat(prefix > 0, shared)
        bits = np.zeros((len(keep), 64 * LONGS), dtype=np.uint8)
        bits[np.repeat(np.arange(len(keep)), shared[keep]), (shingle[held] >> U(20) & U(64 * LONGS - 1)).astype(np.int64)] = 1
        offsets = np.concatenate(([0], np.cumsum(shared[keep]))).astype(np.int32)
        columns = [
            pa.array(owner[first[keep]].view(np.int64)),
            pa.array(n[keep].astype(np.int32)),
            pa.array(prefix[keep].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle[held].view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * LONGS), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel())),
        ]
        return pa.Table.from_arrays(columns, names=["owner", "n", "prefix", "shared", "bits"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b), each there once, that reach the threshold."""
    left = sets.select(F.col("owner").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("owner").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(limit.reached(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b")


def _may_link(limit: Threshold) -> Column:
    """Whether a match (ia, ib: its places among the shared shingles of a and b) may be of a pair that links.

    Before the match at most the lesser place can be common, after it at most the lesser rest. A shingle of one set whose
    bit the other's signature lacks is not in the other: over the whole set, that bounds what prefix and suffix share.
    """
    need = limit.overlap(F.col("na"), F.col("nb"))
    position = F.least("ia", "ib") + 1 + F.least(F.col("oa") - F.col("ia"), F.col("ob") - F.col("ib")) - 1 >= need
    lacks = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(LONGS)), F.lit(0))
    suffix = (F.col("oa") - lacks("sa", "sb") >= need) & (F.col("ob") - lacks("sb", "sa") >= need)
    return limit.lengths(F.col("na"), F.col("nb")) & (F.least("oa", "ob") >= need) & position & suffix


def _side(marked: DataFrame, x: str) -> DataFrame:
    names = {"owner": x, "component": f"g{x}", "i": f"i{x}", "n": f"n{x}", "o": f"o{x}", "bits": f"s{x}"}
    return marked.select("token", *[F.col(k).alias(v) for k, v in names.items()])


def _spread(marked: DataFrame, links: DataFrame) -> DataFrame:
    """The matches of groups that lie in several components of the links, with each set's component."""
    member = components(links)
    marked = marked.drop("component").join(member, marked["owner"] == member["node"], "left").withColumn("component", F.coalesce("component", "owner")).drop("node")
    several = marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return cut(marked.join(several, "token", "left_semi"), "marked")


def linked(docs: DataFrame, n: int = 5, limit: Threshold = Threshold(80, 100)) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, h, n, owner), h a hash of the text, and verified pairs of sets (a, b) that connect all that are connected.

    Pairs inside one component are not enumerated once it is known: the pairs are not all that link.
    """
    with scope(docs.sparkSession) as keep:
        scanned, links = _linked(docs, n, limit)
        return keep(scanned).select("doc_id", "h", "n", "owner"), keep(links)


def _linked(docs: DataFrame, n: int, limit: Threshold) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    text = docs["text"].alias("text")
    scanned = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text, _text_hash(docs)).mapInArrow(_scan(n), "doc_id long, h long, n long, owner long, often binary"), "scan")
    often = scanned.where("often is not null").select("often").mapInArrow(_reported, "shingle long, sets long")
    often = often.groupBy("shingle").agg(F.sum("sets").alias("sets"))
    documents, shingles = scanned.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = often.where(F.col("sets") > COMMON * documents)
    # at most (shingles of a document) / COMMON rows, however many documents there are
    common = sorted((np.int64(r["shingle"]).view(U), r["sets"]) for r in often.collect())
    ids, counts = np.array([c[0] for c in common], dtype=U), np.array([c[1] for c in common], dtype=np.int64)
    buckets = bucket_count(spark, shingles, 16)
    dealt = docs.select(text).mapInArrow(_deal(n, buckets, ids, counts), _POSTINGS).repartitionById(buckets, F.col("bucket"))
    counted = dealt.groupBy("bucket").applyInArrow(_count(buckets), _POSTINGS).repartitionById(buckets, F.col("bucket"))
    sets = cut(counted.groupBy("bucket").applyInArrow(_assemble(limit), _SETS), "sets")
    marked = sets.select("owner", "n", F.size("shared").alias("o"), "bits", F.posexplode(F.slice("shared", 1, F.col("prefix"))).alias("i", "token"))

    # in each group, with the set that shares most of itself
    lead = F.min(F.struct((1 - F.col("o") / F.col("n")).alias("own"), F.col("owner").alias("b"), F.col("n").alias("nb")))
    leads = marked.groupBy("token").agg(lead.alias("lead"), F.count("*").alias("size")).where("size > 1").select("token", "lead.b", "lead.nb")
    stars = marked.select("token", F.col("owner").alias("a"), F.col("n").alias("na")).join(leads, "token")
    stars = stars.where((F.col("a") != F.col("b")) & limit.lengths(F.col("na"), F.col("nb"))).groupBy("a", "b").agg(F.count("*").alias("met"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("met", "b")).alias("b"))  # two groups may pair a and b both ways
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(_verified(best, sets, limit), "links")

    for turn in range(2):
        marked = _spread(marked, links)
        own = Window.partitionBy("token", F.pmod(F.xxhash64("owner"), F.lit(PARTS))).orderBy(F.xxhash64("token", "owner", F.lit(turn)))
        before = F.lag(F.struct(*[F.col(c) for c in ("owner", "component", "i", "n", "o", "bits")])).over(own)
        chained = marked.withColumn("before", before).where(F.col("before.component") != F.col("component"))
        names = {"owner": "", "component": "g", "i": "i", "n": "n", "o": "o", "bits": "s"}
        pairs = chained.select(*[F.col(k).alias(v + "a") for k, v in names.items()], *[F.col(f"before.{k}").alias(v + "b") for k, v in names.items()])
        pairs = pairs.where(_may_link(limit)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = cut(links.union(_verified(pairs, sets, limit)), "links")

    # whatever is in different components still
    marked = _spread(marked, links)
    met = _side(marked, "a").join(_side(marked, "b"), "token").where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _may_link(limit))
    last = _verified(cut(met.select("a", "b").distinct(), "candidates"), sets, limit)
    return scanned, cut(links.union(last), "links")


def _text_hash(docs: DataFrame) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h")


def _grouped(docs: DataFrame, n: int, limit: Threshold) -> DataFrame:
    with scope(docs.sparkSession) as keep:
        found = _linked(docs, n, limit)
        keep(found[0])
        return _members(*found, keep)


def _members(scanned: DataFrame, links: DataFrame, keep) -> DataFrame:
    member = components(links)
    least = scanned.where("owner is not null").groupBy("owner").agg(F.min("doc_id").alias("least"))
    least = least.join(member, least["owner"] == member["node"], "left").select("owner", "least", F.coalesce("component", "owner").alias("component"))
    of = least.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = keep(cut(least.join(of, "component").select(F.col("owner").alias("of_owner"), "component_id", "component"), "ids"))
    out = scanned.join(ids, scanned["owner"] == ids["of_owner"], "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def groups(docs: DataFrame, n: int = 5, limit: Threshold = Threshold(80, 100)) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each document."""
    return _grouped(docs, n, limit).drop("h", "component")


def keep_one(docs: DataFrame, n: int = 5, limit: Threshold = Threshold(80, 100)) -> DataFrame:
    """One document of each group, with all its columns: the one of the least id (null ids last), text hash and row hash.

    Rows are told apart by id and text first. What goes is the smaller part, so the join is against that.
    """
    none = F.lit(-(1 << 63))
    with scope(docs.sparkSession) as keep:
        found = cut(_grouped(docs, n, limit).withColumn("id", F.coalesce("doc_id", none)), "grouped")
        grouped = found.where("component is not null").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "id", "h").alias("own"))
        best = grouped.groupBy("component").agg(F.min("own").alias("best"))
        gone = keep(cut(grouped.distinct().join(best, "component").where("own <> best").select("own.id", "own.h"), "gone"))
        twice = keep(cut(found.where("n_shingles > 0").groupBy("id", "h").count().where("count > 1").select("id", "h"), "twice"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"].cast("long"), none).alias("id"), _text_hash(docs))
    rows = rows.join(F.broadcast(gone) if gone.count() <= FEW_GONE else gone, ["id", "h"], "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    again = rows.join(twice, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return rows.join(twice, ["id", "h"], "left_anti").select("row.*").unionByName(again)
