"""Secret scanning with a random forest that removes false positives. DataFrame functions only.

Candidates are of two kinds. A run of ``RUN`` key characters that holds a digit, both cases or capitals only is one wherever
it stands in a word of the text. A value of any length and any signs is one where it is assigned to a name that speaks for a
secret: in one word (``api_key="x"``), or after a word that ends with ``=``, ``:`` or says bearer (``my password = "x"``);
quotes, brackets and the punctuation of the sentence around it are not part of it. A value with white space inside is taken
to its first word, and a secret in prose without such a name is found from 16 characters on.

The features of a candidate are its length, character transitions, the share of it that dictionary words cover, hints in the
path and the neighbouring words. The dictionary is ``DICTIONARY`` with the ``DICTIONARY_WORDS`` most frequent words of the
corpus, counted over all of it. The forest is trained on labelled findings (Spark's own forest on the JVM) and compiled to
one SQL expression, so scanning is a projection over the text: no join, no shuffle, nothing sent out but the expression.

``labelled_findings`` makes labelled findings of the usual shapes from hashes of a row number; any table with columns
(value, before, after, path, is_secret), and word if it is known, serves as well. ``max_labelled`` bounds what is trained on:
the findings that are least by their hash.

Defined cases: null texts have no candidates; a null path has no hints; texts of any length are scanned whole; repeated rows
give equal findings; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "[A-Za-z0-9+/_-]{16,}"
KEY_LIKE = "[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]|^[A-Z_-]+$"
#: A name, a sign of assignment and what follows, in one word; and a word after which a value follows.
_OPEN, _SHUT = r"""["'`(\[{<]*""", r"""["'`)\]}>,;.!?]*"""
INSIDE = rf"""^{_OPEN}([A-Za-z][A-Za-z0-9_.-]*)["'`\])]*(?:=>|:=|[=:])(.+)$"""
ASSIGNS = r"""(?i)(?:=>|[=:])["'`]?$|^["'`]?bearer$"""
QUOTED, STRIPPED = r"""^[(\[{<]*(["'`])(.+?)\1""", f"^{_OPEN}(.*?){_SHUT}$"
DICTIONARY_WORDS = 1000
REDACTED = "[REDACTED]"

#: Words that speak for and against a secret nearby, hints in paths, and the dictionary.
FOR = "(?i)token|secret|passw|api|key|auth|credential|bearer|private|access"
AGAINST = "(?i)commit|sha\\d*$|checksum|md5|digest|uuid|guid|hash|version|revision|build|order|invoice|isbn|etag|request|trace|session|card|phone|account"
HINTS = "(?i)test|example|sample|fixture|mock|docs?/|readme|vendor"
DICTIONARY = (
    "account access action address admin article auth build cache client cloud code commit config connection content "
    "context control create current custom data database date default delete demo detail dev device docs document "
    "domain download email end error event example field file filter folder form format from function get global "
    "group head header help here home host html image import index info install item java key library link list local "
    "log login main message method mobile module name network new next node note number object order output page "
    "panel parent password path private process product profile project public query read record report request "
    "resource response result root sample save script search secret select server service session set settings setup "
    "show sign site size status style summary system table team template temp test text theme this time title token "
    "total type update upload user value version video view web week word year your zone"
).split()

FEATURES = (
    "length", "digits", "uppers", "turns", "distinct", "vowels", "marks", "covered", "hex", "uuid", "repeats", "for_before",
    "against_before", "assigned", "quoted", "hinted", "against_after", "signs", "word_like", "number_like", "name_like",
)


def corpus_dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """DICTIONARY and the ``size`` most frequent words of four letters or more; of equally frequent ones the first."""
    spelled = docs.select(F.explode(F.split("text", "\\s+")).alias("word")).where(F.length("word") >= 4).groupBy("word").agg(F.count("*").alias("n"))
    plain = spelled.where(F.col("word").rlike("^\\p{Lu}?\\p{Ll}{3,}[.,;:!?]?$"))
    low = plain.groupBy(F.lower(F.regexp_replace("word", "[.,;:!?]$", "")).alias("word")).agg(F.sum("n").alias("n"))
    return sorted({*DICTIONARY, *(r["word"] for r in low.orderBy(F.desc("n"), "word").limit(size).collect())})


def features(value: Column, before: Column, after: Column, path: Column, word: Column, dictionary: list[str] = DICTIONARY) -> list[Column]:
    """The features of a candidate, each a double, in the order of FEATURES."""
    low, size = F.lower(value), F.length(value).cast("double")
    share = lambda pattern, of=value: F.regexp_count(of, F.lit(pattern)) / size
    flag = lambda of, pattern: F.coalesce(of.rlike(pattern), F.lit(False)).cast("double")
    around = F.regexp_replace(F.replace(word, value, F.lit(" ")), RUN, " ")
    near = F.concat_ws(" ", before, around)
    return [
        size,
        share("[0-9]"),
        share("[A-Z]"),
        share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        F.size(F.array_distinct(F.split(value, ""))) / size,
        share("[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])", low),
        share("[-_/+]"),
        1 - F.length(F.regexp_replace(low, "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), "")) / size,
        flag(value, "^([0-9a-f]+|[0-9A-F]+)$"),
        flag(low, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
        flag(low, "(.)\\1{3}"),
        flag(near, FOR),
        flag(near, AGAINST),
        flag(near, "[=:]"),
        flag(word, "[\"'`]"),
        flag(path, HINTS),
        flag(after, AGAINST),
        share("[^A-Za-z0-9]"),
        flag(value, "^\\p{L}\\p{Ll}*(['\u2019-]\\p{L}\\p{Ll}*)*$"),
        flag(value, "^[-+$#]?[0-9]+([.,:/-][0-9]+)*%?$"),
        flag(value, "^(https?://|[.~]?/|\\$|%|--|\\w+\\(|[A-Za-z_]+\\.[A-Za-z_.]+$|[\\w.]+@[\\w.]+$)"),
    ]


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 11) -> DataFrame:
    """Labelled findings (value, before, after, path, is_secret) of common shapes, made from hashes of row numbers."""
    h = lambda k: F.sha2(F.concat_ws("|", F.lit(f"{seed}-{k}"), F.col("id")), 256)
    pick = lambda k, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.conv(F.substring(h(k), 1, 6), 16, 10).cast("int") % len(of) + 1))
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(h("m"), h("n")))), "[=+/]", "k")
    capitals = F.translate(F.upper(h("c")), "0123", "QWZT")
    shape = F.pmod(F.col("id"), F.lit(40))
    words = lambda sep: F.concat_ws(sep, pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY), F.substring(F.conv(F.substring(h("y"), 1, 8), 16, 10), 1, 4))
    digits = lambda k, n: F.substring(F.conv(F.substring(h(k), 1, 14), 16, 10), 2, n)
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    sign = lambda k: pick(k, list("!#$%&*?@^~+"))
    dashed = F.regexp_replace(F.substring(mixed, 1, 36), "(.{12})(.{12})(.{12})", "$1-$2-$3")
    secrets = [
        F.substring(h("a"), 1, 40), F.substring(h("a"), 1, 32), h("a"), F.upper(F.substring(h("a"), 1, 40)), F.substring(mixed, 1, 40),
        F.substring(mixed, 3, 24), F.substring(mixed, 2, 64), F.concat(F.lit("AKIA"), F.substring(capitals, 1, 16)),
        F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat(F.lit("sk-"), F.substring(mixed, 1, 44)),
        F.substring(mixed, 1, 12), F.substring(mixed, 5, 9), F.concat(pick("w1", DICTIONARY), digits("d", 3)), F.concat(pick("w1", DICTIONARY), digits("d", 1), F.substring(mixed, 1, 3)),
        F.concat(F.substring(mixed, 1, 5), sign("s1"), F.substring(mixed, 9, 4), sign("s2")), F.concat(F.initcap(pick("w1", DICTIONARY)), sign("s1"), digits("d", 4)),
        F.concat(F.lit("xoxb-"), digits("d", 11), F.lit("-"), digits("e", 12), F.lit("-"), F.substring(mixed, 1, 24)), dashed,
        F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit(".eyJ"), F.substring(mixed, 5, 40), F.lit("."), F.substring(mixed, 9, 43)), F.substring(capitals, 1, 16),
    ]
    harmless = [
        F.substring(F.concat(F.conv(F.substring(h("d"), 1, 14), 16, 10), F.conv(F.substring(h("d"), 15, 14), 16, 10)), 1, 16),
        F.substring(h("b"), 1, 40), uuid, words("-"), words("_"), F.concat(F.lit("your_api_key_here_"), F.substring(h("p"), 1, 2)),
        F.concat(F.repeat(pick("x", ["x", "0", "X", "a"]), 20), F.lit("1")), F.concat(words("/"), F.lit("/2")), h("b"),
        F.concat(F.substring(F.conv(F.substring(h("e"), 1, 12), 16, 10), 1, 12), F.repeat(F.lit("0"), 6)),
        pick("w1", DICTIONARY), F.initcap(pick("w1", DICTIONARY)), F.concat(pick("w1", DICTIONARY), pick("l", ["en", "es", "ung", "ment", "a", "s"])), digits("d", 2), F.concat(digits("d", 1), F.lit("."), digits("e", 1), F.lit("."), digits("y", 2)),
        F.concat(F.lit("https://"), words(".")), F.concat(F.lit("$"), F.upper(words("_"))), F.concat(words("."), F.lit("()")), F.concat(pick("w1", DICTIONARY), F.lit("-"), pick("w2", DICTIONARY)), pick("v", ["none", "null", "true", "required", "<hidden>", "changeme", "********", "..."]),
    ]
    secret = shape < 20
    value = reduce(lambda so_far, kv: F.when(shape == kv[0], kv[1]).otherwise(so_far), enumerate(secrets + harmless), F.lit(""))
    told = ["token =", "secret :", "api_key =", "password =", "Authorization: Bearer", "access key", "private_key :", "auth ="]
    plain = ["commit", "sha256", "request id", "order", "card", "see", "the version", "checksum :", "of", "build"]
    hidden = F.conv(F.substring(h("q"), 1, 2), 16, 10).cast("int") % 10 == 0
    placeholder = (shape >= 30) | shape.isin(25, 26)  # what stands where a key would
    before = F.when(secret | placeholder | (shape.isin(23, 24) & hidden), pick("t", told)).otherwise(pick("f", plain))
    path = F.when(secret, pick("s", ["src/app", "config/prod", "web", "src3", "notes"])).otherwise(pick("g", ["src/app", "config/prod", "web", "src3", "notes", "tests/data", "docs/readme"]))
    return spark.range(rows).select(value.alias("value"), before.alias("before"), pick("z", ["", "with", "and", "commit"]).alias("after"), path.alias("path"), secret.cast("int").alias("is_secret"))


def _tree(node, inputs: list[Column]) -> Column:
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return F.lit(float(stats[1] / (sum(stats) or 1)))
    split = node.split()
    return F.when(inputs[split.featureIndex()] <= split.threshold(), _tree(node.leftChild(), inputs)).otherwise(_tree(node.rightChild(), inputs))


class Forest:
    """A trained forest; call it with the features to get the column of its votes' mean."""

    def __init__(self, findings: DataFrame, trees: int = 15, depth: int = 6, max_labelled: int = 20_000, dictionary: list[str] = DICTIONARY) -> None:
        from pyspark.ml.classification import RandomForestClassifier

        self.dictionary = dictionary
        rows = findings.orderBy(F.xxhash64("value", "before", "after", "path", "is_secret"), "value").limit(max_labelled).coalesce(2)
        if "word" not in findings.columns:  # unknown: half of them in quotes
            rows = rows.withColumn("word", F.when(F.pmod(F.xxhash64("value"), F.lit(2)) == 0, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value")))
        rows = self.measured(rows).select(F.col("is_secret").cast("double").alias("label"), "features")
        self.model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8, featureSubsetStrategy="onethird").fit(rows)
        self.roots = [t._call_java("rootNode") for t in self.model.trees]

    def features(self, *of: Column) -> list[Column]:
        return features(*of, dictionary=self.dictionary)

    def measured(self, findings: DataFrame) -> DataFrame:
        """Findings (value, before, after, path, word, ...) with the vector ``features``."""
        from pyspark.ml.functions import array_to_vector

        return findings.withColumn("features", array_to_vector(F.array(*self.features(*[F.col(c) for c in ("value", "before", "after", "path", "word")]))))

    def __call__(self, inputs: list[Column]) -> Column:
        return reduce(Column.__add__, [_tree(r, inputs) for r in self.roots]) / len(self.roots)


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), use)[0]


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """(row, findings): each document's row with an array of (at, value, score, is_secret), ``at`` its word's number."""
    where = docs[path].cast("string") if path in docs.columns else F.lit(None).cast("string")
    near = lambda words, i, k: F.coalesce(F.get(words, i + k), F.lit(""))

    def spotted(words: Column) -> Column:
        word = lambda i: F.get(words, i)
        before = lambda i: F.concat_ws(" ", near(words, i, -2), near(words, i, -1))

        def assigned(i: Column) -> Column:
            """The value that word i assigns or is assigned, or nothing."""
            own = F.regexp_extract(word(i), INSIDE, 1).rlike(FOR)
            given = near(words, i, -1).rlike(ASSIGNS) & before(i).rlike(FOR)
            return F.when(own, F.regexp_extract(word(i), INSIDE, 2)).when(given, word(i)).otherwise(F.lit(""))

        def of_word(i: Column) -> Column:
            value = _let(assigned(i), lambda v: F.coalesce(F.nullif(F.regexp_extract(v, QUOTED, 2), F.lit("")), F.regexp_extract(v, STRIPPED, 1)))
            runs = F.filter(F.regexp_extract_all(word(i), F.lit(f"({RUN})"), F.lit(1)), lambda v: v.rlike(KEY_LIKE))
            return _let(value, lambda v: F.concat(F.filter(F.array(v), lambda x: x != ""), F.filter(runs, lambda r: ~F.contains(v, r))))

        long = lambda i: (F.length(word(i)) >= 16) & word(i).rlike(RUN)
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: long(i) | word(i).rlike("[=:].") | near(words, i, -1).rlike(ASSIGNS))
        found = F.transform(at, lambda i: F.transform(  # a word may hold several
            of_word(i), lambda v: F.struct(i.alias("at"), v.alias("value"), word(i).alias("word"), before(i).alias("before"), near(words, i, 1).alias("after")),
        ))
        return F.flatten(found)

    def judged(c: Column) -> Column:
        measured = F.struct(*[f.alias(n) for f, n in zip(forest.features(c["value"], c["before"], c["after"], where, c["word"]), FEATURES)])
        score = _let(measured, lambda m: forest([m[n] for n in FEATURES]))
        return _let(score, lambda s: F.struct(c["at"].alias("at"), c["value"].alias("value"), s.alias("score"), (s >= threshold).alias("is_secret")))

    found = _let(F.split(F.coalesce(docs["text"], F.lit("")), "\\s+"), lambda words: F.transform(spotted(words), judged))
    return docs.select(F.struct("*").alias("row"), found.alias("findings"))


def findings(docs: DataFrame, forest: Forest, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """Rows (doc_id, at, length, value_sha256, score, is_secret), one a candidate. The value itself is not repeated."""
    rows = scan(docs, forest, threshold, path).select("row.doc_id", F.explode_outer("findings").alias("f")).where("f is not null")
    return rows.select("doc_id", "f.at", F.length("f.value").alias("length"), F.sha2("f.value", 256).alias("value_sha256"), "f.score", "f.is_secret")


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """The documents, with every value found secret replaced in ``text`` and ``n_chars`` set anew where there is one."""
    rows = scan(docs, forest, threshold, path)
    values = F.array_distinct(F.transform(F.filter("findings", lambda f: f["is_secret"]), lambda f: f["value"]))
    longest_first = F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    clean = F.aggregate(longest_first, F.col("row.text"), lambda text, s: F.replace(text, s["v"], F.lit(REDACTED)))
    rows = rows.select("row", clean.alias("clean"))
    put = lambda c: F.col("clean") if c == "text" else F.when(F.col("clean") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.coalesce(F.length("clean"), F.col("row.n_chars"))) if c == "n_chars" else F.col(f"row.`{c}`")
    return rows.select(*[put(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
