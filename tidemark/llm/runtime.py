"""Where intermediate tables go, how long they stay, and how rows are dealt."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []
#: What a bucket of packed rows that one Python call holds should come to.
BUCKET_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (local mode, tests) the driver's
    own temporary folder serves, since driver and executors are one process there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        _own["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there.

    A lost executor then costs the tasks it ran, not what led to them.
    """
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    if _scopes:
        _scopes[-1].append(path)
    return table


@contextmanager
def scope(spark: SparkSession) -> Iterator:
    """Tables cut inside are deleted at the end, but those given to the function that this yields.

    Whatever is read afterwards must come from a kept table, or from none of them.
    """
    kept: set[str] = set()

    def keep(*tables: DataFrame):
        kept.update(_paths[t] for t in tables)
        return tables[0] if len(tables) == 1 else tables

    _scopes.append([])
    try:
        yield keep
    finally:
        made = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        delete(spark, *(p for p in made if p not in kept))


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders, wherever Spark's own file systems reach."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Into how many buckets so many packed rows are dealt: by their size, and no fewer than the shuffle's width."""
    return max(shuffle_width(spark), -(-int(rows) * row_bytes // BUCKET_BYTES))


def column_or_null(df: DataFrame, name: str, kind: str):
    """``df[name]`` as ``kind``, or a null column where the table has none of that name."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)
