"""A keyed store of chunks: insert or replace, delete, and rewriting as a new version."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.shared import written


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the largest ``version``. Aggregated before rows move, so many rows of one key stay cheap."""
    both = old.unionByName(new)
    names = [c for c in both.columns if c != key]
    newest = F.max_by(F.struct(*names), F.struct(F.col(version), F.xxhash64(*names)))
    return both.groupBy(key).agg(newest.alias("__row")).select(key, *[F.col(f"__row.`{c}`") for c in names]).select(*both.columns)


def delete(store: DataFrame, ids: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Without the rows whose key or whose parent is among ``ids`` (its first column)."""
    gone = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    left = store.join(gone, F.col(key) == F.col("__id"), "left_anti")
    return left.join(gone, F.col(parent) == F.col("__id"), "left_anti")


class Versions:
    """A Parquet table at ``root`` as numbered versions; a pointer file is replaced last, so a write that fails leaves the old one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self) -> DataFrame | None:
        at = self.current()
        return self.spark.read.parquet(f"{self.root}/{at[1]}") if at else None

    def current(self) -> tuple[int, str] | None:
        """(number, folder) of the version in force: the largest number with a marker."""
        fs, path = self._fs("versions")
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [(int(n.split("-")[0]), n) for n in names if n[:1].isdigit()]
        return max(done, default=None)

    def write(self, rows: DataFrame, number: int) -> None:
        name = f"{number}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{name}")
        fs, path = self._fs(f"versions/{name}")
        fs.create(path, True).close()


class Buckets:
    """A Parquet store of one row a key, in folders by the key's hash: a batch rewrites the folders that its keys lie in.

    A batch that runs again changes nothing, as of a key's rows the one of the largest ``version`` stays. New folders
    are made whole before they take the old ones' places, one after the other; a run that breaks off there is to be
    run again.
    """

    COLUMN = "bucket"

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.version, self.buckets = spark, root.rstrip("/"), key, version, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.COLUMN, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _held(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.root) if fs.exists(path) and any(s.isDirectory() and s.getPath().getName().startswith(f"{self.COLUMN}=") for s in fs.listStatus(path)) else None

    def read(self) -> DataFrame | None:
        held = self._held()
        return None if held is None else held.drop(self.COLUMN)

    def put(self, batch: DataFrame) -> int:
        """Inserts or replaces; how many folders were written."""
        rows = written(self._placed(batch), "store-batch")
        touched = sorted(r[0] for r in rows.select(self.COLUMN).distinct().collect())  # no more than there are buckets
        if touched:
            held = self._held()
            old = rows.limit(0) if held is None else held.where(F.col(self.COLUMN).isin(touched)).select(*rows.columns)
            self._replace(upsert(old, rows, self.key, self.version))
        return len(touched)

    def remove(self, ids: DataFrame, parent: str) -> None:
        """Without the rows whose key or parent is among ``ids``; only folders that hold such rows are written."""
        held = self._held()
        if held is None:
            return
        left = delete(held, ids, self.key, parent)
        before = held.groupBy(self.COLUMN).agg(F.count(F.lit(1)).alias("n"))
        after = left.groupBy(self.COLUMN).agg(F.count(F.lit(1)).alias("m"))
        changed = [r[0] for r in before.join(after, self.COLUMN, "left").where("m is null or m < n").select(self.COLUMN).collect()]
        if changed:
            self._replace(left.where(F.col(self.COLUMN).isin(changed)), changed)

    def _replace(self, rows: DataFrame, folders: list[int] | None = None) -> None:
        whole = written(rows.select(*[c for c in rows.columns if c != self.COLUMN], self.COLUMN), "store-rows")
        whole.repartition(self.COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.COLUMN).parquet(self.root)
        if folders:
            kept = {r[0] for r in whole.select(self.COLUMN).distinct().collect()}
            for b in set(folders) - kept:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.COLUMN}={b}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def put_or_report(rows: DataFrame, key: str, put: Callable[[DataFrame], object], tries: int = 2) -> list[tuple[str, str]]:
    """Puts rows into a store that may refuse some: a batch that fails ``tries`` times is halved by the keys' hashes until what fails is one key.

    Returns (key, error) of the keys left out. Every good row is put, most of them once; a bad one costs some twenty tries.
    """
    held = written(rows.withColumn("__h", F.xxhash64(F.col(key).cast("string"))), "store-put")
    left, todo = [], [(0, 0)]
    while todo:
        bits, value = todo.pop()
        part = held.where(F.shiftrightunsigned("__h", 64 - bits) == value) if bits else held
        if part.isEmpty():
            continue
        error = None
        for _ in range(tries):
            try:
                put(part.drop("__h"))
                error = None
                break
            except Exception as e:  # what a store raises is its own
                error = e
        if error is None:
            continue
        few = [r[0] for r in part.select(key).distinct().limit(2).collect()]
        if len(few) == 1 or bits == 62:
            left += [(str(k), str(error).split("\n")[0]) for k in few]
        else:
            todo += [(bits + 1, 2 * value + 1), (bits + 1, 2 * value)]
    return sorted(left)
