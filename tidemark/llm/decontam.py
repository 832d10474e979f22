r"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

The index holds postings (term, document, position) of the corpus for the terms that benchmark items use, made in one pass
over the texts; another benchmark needs another pass. A posting of a negative term is a document's own: its position is
the document's number of words. A window of an item's words is a list of (term, offset). Its terms are intersected from
the rarest in the corpus: the rarest one's postings, less its offset, are the candidate starts; the next one's
offset-adjusted postings thin them out; the others, all at once, decide. With ``slop`` above 0 a term may stand up to so
many words from its place: proximity matches.

Postings meet the vocabulary and the windows by broadcast where these have been counted to be within ``MAX_BROADCAST``
rows; beyond that they are shuffled by term and salt, so a frequent term is split among ``SALTS`` tasks. Candidates meet
postings by (document, position), which no frequent term or long document can make hot; before that, postings of documents
without candidates are left out by their bucket, at most ``MAX_BROADCAST`` buckets whatever the corpus.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z lowered. The class of words is closed under
case, so texts are split as they are, and a word meets its term by its Unicode lower case, then exactly.

Defined cases: null texts have no words; an item of fewer than ``n`` words, but not none, is one window; items without
words match nothing; a null item_id is written as an empty string; repeated items count once by item_id; repeated
document rows each get their own result; a term that the corpus lacks makes its windows impossible; empty tables give
empty results or no hits; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, scope

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_BROADCAST, SALTS = 1 << 18, 64
#: What stands before a document's words, for an id and for none, and the terms of these: no word is empty or a space.
_DOCUMENT, _NAMELESS = ("", -1), (" ", -2)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words as they are spelled."""
    return F.array_remove(F.split(text, SEPARATOR), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def _by_key(postings: DataFrame, df: DataFrame, key: str, rows: int) -> DataFrame:
    """Postings (with doc and pos) joined to ``df``, which has so many rows: by broadcast, or by key and salt."""
    if rows <= MAX_BROADCAST:
        return postings.join(F.broadcast(df), key)
    salted = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.hash("doc", "pos"), F.lit(SALTS))).join(salted, [key, "salt"]).drop("salt")


def _doc(docs: DataFrame) -> Column:
    """doc_id, with the least long for null, so that null joins itself."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))


def _h(docs: DataFrame) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def item_windows(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms (word, term), windows (window, len, term, offset) and their items (window, item_id), with ids that stay."""
    one = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), words(lowered(items["text"])).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    spelled = one.select("item_id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, n), " "))).alias("spelled")).distinct()
    ids = cut(spelled.select("spelled").distinct().coalesce(1).withColumn("window", F.monotonically_increasing_id()), "windows")
    vocabulary = ids.select(F.explode(F.split("spelled", " ")).alias("word")).distinct().coalesce(1)
    terms = cut(vocabulary.withColumn("term", F.monotonically_increasing_id()), "terms")
    parts = ids.select("window", F.size(F.split("spelled", " ")).alias("len"), F.posexplode(F.split("spelled", " ")).alias("offset", "word"))
    return terms, parts.join(_small(terms, terms.count()), "word").select("window", "len", "term", "offset"), spelled.join(ids, "spelled").select("window", "item_id")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, h, pos) of the given terms and of the documents, written to the shared folder."""
    own = F.when(docs["doc_id"].isNull(), F.lit(_NAMELESS[0])).otherwise(F.lit(_DOCUMENT[0]))
    split = docs.select(_doc(docs).alias("doc"), _h(docs).alias("h"), own.alias("own"), F.coalesce(words(docs["text"]), F.array().cast("array<string>")).alias("w"))
    split = split.select("doc", "h", F.size("w").alias("n"), F.concat(F.array("own"), "w").alias("w"))
    tokens = split.select("doc", "h", "n", F.posexplode("w").alias("pos", "word")).withColumn("key", F.lower("word"))
    pairs = F.array(*[F.struct(F.lit(w).alias("spelled"), F.lit(t).cast("long").alias("term")) for w, t in (_DOCUMENT, _NAMELESS)])
    markers = docs.sparkSession.range(1).select(F.inline(pairs))
    known = terms.select(F.col("word").alias("spelled"), "term").unionByName(markers).withColumn("key", F.lower("spelled"))
    found = _by_key(tokens, known, "key", terms.count() + 2).where((F.col("word") == F.col("spelled")) | (lowered(F.col("word")) == F.col("spelled")))
    return cut(found.select("term", "doc", "h", F.when(F.col("term") < 0, F.col("n")).otherwise(F.col("pos") - 1).alias("pos")), "postings")


def _of_wanted(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of documents that may be among the wanted ones."""
    bucket = F.pmod(F.hash("doc", "h"), F.lit(MAX_BROADCAST or 1)).alias("bucket")
    return postings.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


def match(postings: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Occurrences (window, len, doc, h, start): every term of the window within ``slop`` of its place."""
    postings = postings.where("term >= 0")
    frequency = cut(postings.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    ranked = windows.join(_small(frequency, frequency.count()), "term").groupBy("window", "len").agg(F.sort_array(F.collect_list(F.struct("df", "term", "offset"))).alias("parts"))
    ranked = cut(ranked.where(F.size("parts") == F.col("len")), "ranked")
    count, in_all = ranked.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()  # windows, and their terms
    lead = ranked.select("window", F.col("parts")[0]["term"].alias("term"), F.col("parts")[0]["offset"].alias("offset"))
    starts = _by_key(postings, lead, "term", count).select("window", "doc", "h", (F.col("pos") - F.col("offset")).alias("start")).where(f"start >= -{slop}")

    def near(wanted: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
        """wanted with the postings of its terms at the places they should have."""
        shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
        wanted = wanted.withColumn("shift", shift).withColumn("pos", F.col("start") + F.col("offset") + F.col("shift"))
        terms = cut(terms.distinct(), "terms")
        return wanted.join(_by_key(found, terms, "term", terms.count()), ["doc", "h", "pos", "term"])

    second = ranked.where("len > 1").select("window", F.col("parts")[1]["term"].alias("term"), F.col("parts")[1]["offset"].alias("offset"))
    thinned = near(starts.join(_small(second, count), "window"), postings, second.select("term")).select("window", "doc", "h", "start").distinct()
    thinned = cut(thinned, "thinned")
    rest = ranked.where("len > 2").select("window", "len", F.explode(F.slice("parts", 3, F.size("parts"))).alias("part"))
    rest = rest.select("window", "len", "part.term", "part.offset")
    decided = near(thinned.join(_small(rest, in_all), "window"), _of_wanted(postings, thinned), rest.select("term"))
    decided = decided.groupBy("window", "len", "doc", "h", "start").agg(F.count_distinct("offset").alias("n")).where("n = len - 2")
    kept = ["window", "len", "doc", "h", "start"]
    short = lambda df, n: df.join(_small(ranked.where(f"len = {n}").select("window", "len"), count), "window").select(*kept)
    return decided.select(*kept).union(short(starts.distinct(), 1)).union(short(thinned, 2))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 0) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    with scope(docs.sparkSession) as keep:
        index, hits, found = _hits(docs, items, n, slop)
        keep(index, hits)
        found = keep(cut(found, "found"))
    places = hits.select("doc", "h", F.explode(F.sequence(F.greatest("start", F.lit(0)), F.col("start") + F.col("len") - 1)).alias("pos"))
    counts = places.distinct().groupBy("doc", "h").agg(F.count("*").alias("n_hit"))
    per = found.groupBy("doc", "h").agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256")
    )
    doc_id = F.when(F.col("term") == _DOCUMENT[1], F.col("doc")).cast(docs.schema["doc_id"].dataType)
    rows = index.where("term < 0").select(doc_id.alias("doc_id"), "doc", "h", F.col("pos").cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(counts.join(per, ["doc", "h"]), ["doc", "h"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def _hits(docs: DataFrame, items: DataFrame, n: int, slop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, occurrences, and the items (doc, h, item_id) they come from, once each."""
    terms, windows, of_items = item_windows(items, n)
    index = build_index(docs, terms)
    hits = cut(match(index, windows, slop), "matches")
    return index, hits, hits.select("window", "doc", "h").distinct().join(of_items, "window").select("doc", "h", "item_id").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    with scope(docs.sparkSession) as keep:
        hits = keep(cut(_hits(docs, items, n, 0)[1].select("doc", "h").distinct(), "contaminated"))
    rows = docs.select(F.struct("*").alias("row"), _doc(docs).alias("doc"), _h(docs).alias("h"))
    return rows.join(_small(hits, hits.count()), ["doc", "h"], "left_anti").select("row.*")
