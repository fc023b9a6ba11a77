"""Sinks: BI tables as Parquet (default) or CSV with a header, and month slices that can be
replaced one by one.

Every write is staged: the rows go to a folder of their own first, and the folder is put
in place only when Spark has written all of it. A write that fails leaves what was there before.
Paths are handled through Hadoop's file system interface, so they may be in any store Spark reads.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "parquet":
        df.write.parquet(path)
    elif fmt == "csv":
        df.write.option("header", True).option("nullValue", "").csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_mart(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write one mart table, replacing what is at ``path``. Marts are aggregated
    (months, states, categories, sellers), so they are small; they are written by the
    executors that hold them, never collected to the driver. The old table stays until the
    new one is complete, and comes back if the new one cannot be put in its place."""
    spark = df.sparkSession
    path = path.rstrip("/")
    tag = uuid.uuid4().hex[:12]
    staged, replaced = f"{path}.staged-{tag}", f"{path}.replaced-{tag}"
    fs, target = _fs(spark, path)
    try:
        _write(df, staged, fmt)
    except Exception:
        fs.delete(_path(spark, staged), True)
        raise
    there = fs.exists(target)
    if there and not fs.rename(target, _path(spark, replaced)):
        raise OSError(f"cannot replace {path}; the new table is at {staged}")
    if not fs.rename(_path(spark, staged), target):
        if there:
            fs.rename(_path(spark, replaced), target)
        raise OSError(f"cannot put {staged} at {path}")
    if there:
        fs.delete(_path(spark, replaced), True)


class Slices:
    """A table kept as one folder per value of a string column (months), whose slices are
    replaced without touching the others.

    ``batch-<n>/<column>=<value>`` holds the rows; ``_slices/<n>.json`` says which batch has the
    rows of each value, and the schema. A batch counts only when its list is there, which is
    written last: after a failed write the list before it still holds. One writer at a time: a
    second one that takes the same number fails. The values are few (months)."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def _list(self) -> tuple[int, dict]:
        fs, folder = _fs(self.spark, f"{self.path}/_slices")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(name[:-5]) for name in names if name.endswith(".json")]
        if not numbers:
            return 0, {"slices": {}}
        text = self.spark.read.text(f"{self.path}/_slices/{max(numbers):08d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def values(self) -> list[str]:
        return sorted(self._list()[1]["slices"])

    def read(self) -> DataFrame | None:
        """All rows of the current slices, or None where nothing was ever written."""
        last, listed = self._list()
        if not last:
            return None
        schema = T.StructType.fromJson(listed["schema"])
        held: dict[int, list[str]] = {}
        for value, batch in listed["slices"].items():
            held.setdefault(batch, []).append(value)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/batch-{n:08d}").where(F.col(self.column).isin(mine))
                 for n, mine in sorted(held.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame, values: list[str] | None = None) -> None:
        """Put ``rows`` in place of the slices ``values`` (None: of all). Values without a
        row are gone afterwards; rows of other values are left out."""
        last, listed = self._list()
        folder = f"{self.path}/batch-{last + 1:08d}"
        fs, target = _fs(self.spark, folder)
        fs.delete(target, True)  # left by a write that failed
        rows = rows if values is None else rows.where(F.col(self.column).isin(values))
        rows = rows.select([c for c in rows.columns if c != self.column] + [F.col(self.column).cast("string")])
        rows.write.partitionBy(self.column).parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        new = {r[0]: last + 1 for r in written.select(self.column).distinct().collect()}
        old = {} if values is None else {v: b for v, b in listed["slices"].items() if v not in set(values)}
        self._publish(last + 1, {"slices": old | new, "schema": json.loads(rows.schema.json())})

    def _publish(self, n: int, listed: dict) -> None:
        name = f"{self.path}/_slices/{n:08d}.json"
        fs, target = _fs(self.spark, name)
        draft = _path(self.spark, f"{name}.{uuid.uuid4().hex[:12]}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        if not fs.rename(draft, target):
            fs.delete(draft, False)
            raise OSError(f"{name} is there already: another writer was faster")
