"""Labels and matchers.

A series is identified by its labels, MAP<STRING,STRING>: unique names, the last of several values wins, the empty map is
legal. Its canonical key is the sorted array of entries; a label whose value is null is absent. A label that is absent equals
the empty string for matchers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import TsdbError

NAME = "__name__"


def labels_from_entries(entries: Column) -> Column:
    """A label map of an array of (key, value) structs; of equal names the last wins, whatever the session's policy."""
    last = F.transform(
        F.array_distinct(F.transform(entries, lambda e: e["key"])),
        lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")),
    )
    return F.map_from_entries(F.array_sort(last))


def labels_of(**columns: Column | str) -> Column:
    """A label map of columns; ``__name__`` is given as ``metric``.

    Built entry by entry, so a predicate on one label of it becomes a predicate on its column and reaches the scan.
    """
    named = sorted(((NAME if k == "metric" else k, v) for k, v in columns.items()), key=lambda p: p[0])
    named = [(k, F.lit(v) if isinstance(v, str) else v) for k, v in named]
    return F.create_map(*[x for k, v in named for x in (F.lit(k), v)])


def with_label(labels: Column, name: str, value: Column | str) -> Column:
    """Insert or replace one label."""
    kept = F.map_filter(labels, lambda k, _: k != name)
    return F.map_concat(kept, F.create_map(F.lit(name), F.lit(value) if isinstance(value, str) else value))


def series_key(labels: Column) -> Column:
    """Entries sorted by name, without nulls: equal for equal label sets, and fit for grouping, joining and hashing."""
    return F.array_sort(F.filter(F.map_entries(labels), lambda e: e["value"].isNotNull()))


def labels_str(labels: Column) -> Column:
    """``name=value`` sorted by name and joined by commas."""
    return F.array_join(F.transform(series_key(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def labels_hash(labels: Column) -> Column:
    return F.xxhash64(series_key(labels))


def label(labels: Column, name: str) -> Column:
    """A label's value; the empty string if it is absent."""
    return F.coalesce(labels[name], F.lit(""))


def _compiled(pattern: str):
    """A test of whole values by the pattern. Plans run Java's expressions, so its compiler judges and matches here too;
    only without a JVM, before there is a session, Python's stands in."""
    context = SparkContext._active_spark_context
    if context is None:
        try:
            found = re.compile(pattern)
        except re.error as e:
            raise TsdbError("invalid_argument", f"bad pattern {pattern!r}: {e}") from e
        return lambda value: found.fullmatch(value) is not None
    try:
        java = context._jvm.java.util.regex.Pattern.compile(rf"\A(?:{pattern})\z")
    except IllegalArgumentException as e:
        raise TsdbError("invalid_argument", f"bad pattern {pattern!r}: {e}") from e
    return lambda value: java.matcher(value).find()


@dataclass(frozen=True)
class Matcher:
    """One label predicate: kind is one of = != =~ !~. Patterns match the whole value and are checked when made."""

    kind: str
    name: str
    value: str

    def __post_init__(self) -> None:
        if self.kind not in ("=", "!=", "=~", "!~"):
            raise TsdbError("invalid_argument", f"unknown matcher {self.kind}")
        if self.kind in ("=~", "!~"):
            _compiled(self.value)

    @staticmethod
    def equal(name: str, value: str) -> Matcher:
        return Matcher("=", name, value)

    @staticmethod
    def not_equal(name: str, value: str) -> Matcher:
        return Matcher("!=", name, value)

    @staticmethod
    def regex(name: str, pattern: str) -> Matcher:
        return Matcher("=~", name, pattern)

    @staticmethod
    def not_regex(name: str, pattern: str) -> Matcher:
        return Matcher("!~", name, pattern)

    def column(self, labels: Column) -> Column:
        """The predicate over a label map, never null. Equality with a value is in a form that scans can push down."""
        if self.kind == "=" and self.value:
            return labels[self.name].eqNullSafe(self.value)
        return self.on(label(labels, self.name))

    def on(self, value: Column) -> Column:
        """The predicate over a label's value, which is the empty string where the label is absent."""
        if self.kind in ("=", "!="):
            return value == self.value if self.kind == "=" else value != self.value
        # the group keeps alternatives together; \z, unlike $, does not match before a last line feed
        whole = value.rlike(rf"\A(?:{self.value})\z")
        return whole if self.kind == "=~" else ~whole

    def regex_matches(self, value: str) -> bool:
        """Whether the pattern matches, whatever the polarity; False for matchers without one."""
        return self.kind in ("=~", "!~") and _compiled(self.value)(value)

    def matches(self, value: str) -> bool:
        """The predicate on one value, for pruning on the driver."""
        if self.kind in ("=", "!="):
            return (value == self.value) == (self.kind == "=")
        return self.regex_matches(value) == (self.kind == "=~")


def all_of(matchers: Iterable[Matcher], labels: Column) -> Column:
    """Conjunction of matchers; none at all is an error."""
    found = [m.column(labels) for m in matchers]
    if not found:
        raise TsdbError("invalid_argument", "at least one matcher is needed")
    return reduce(Column.__and__, found)
