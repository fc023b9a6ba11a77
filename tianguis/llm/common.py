"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tianguis.session import shared_dir

#: Rows above which a small side is no longer broadcast but joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders for written intermediate tables, the innermost last.
_folders: list[str] = []


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: later jobs
    and retries after a lost executor read the files instead of recomputing. The files lie
    in one folder of the application, which is removed when its session's JVM ends."""
    spark = df.sparkSession
    folder = _folders[-1] if _folders else f"{shared_dir(spark).rstrip('/')}/tianguis-{spark.sparkContext.applicationId}"
    if not _folders:
        fs, p = _file_system(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What ``cut`` writes inside is removed at the end; a result that lives longer is written
    outside before that."""
    folder = f"{shared_dir(spark).rstrip('/')}/tianguis-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    _folders.append(folder)
    try:
        yield
    finally:
        _folders.remove(folder)
        fs, p = _file_system(spark, folder)
        fs.delete(p, True)


@contextmanager
def outside() -> Iterator[None]:
    """``cut`` writes to the folder around the innermost ``scratch``."""
    folder = _folders.pop()
    try:
        yield
    finally:
        _folders.append(folder)


def worker_cache(key: str, make: Callable[[], Any]) -> Any:
    """The value of ``key`` in this Python worker process, built by ``make`` on first use.
    A worker serves one stage after another and keeps the last key's value only."""
    store = sys.modules.setdefault("_tianguis_worker", types.ModuleType("_tianguis_worker"))
    values = store.__dict__.setdefault("values", {})
    if key not in values:
        values.clear()
        values[key] = make()
    return values[key]


class PieceCache:
    """Values of the pieces met lately, at most about ``2 * half`` of them: when
    the young half is full it becomes the old one, and old pieces still in use
    move back. Frequent pieces stay however many rare ones pass by."""

    def __init__(self, half: int, make: Callable[[list[str]], list[Any]]):
        self.half, self.make = half, make
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def of(self, pieces: set[str]) -> dict[str, Any]:
        """A mapping that holds at least ``pieces``."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        missing = pieces.difference(self.young)
        old = {p: self.old[p] for p in missing if p in self.old}
        self.young.update(old)
        fresh = [p for p in missing if p not in old]
        self.young.update(zip(fresh, self.make(fresh)))
        return self.young
