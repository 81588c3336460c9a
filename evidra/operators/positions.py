"""Places of rows in an order of the whole table, and joins by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidra.sources.shared import written


def row_index(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0 and without gaps, by rising values of ``order``, nulls first.

    Rows are sorted by range; a range's rows are counted apart, and the counts of the ranges before it, a number a
    range, are added. Rows that are equal in ``order`` have any order among them, which stays as it was written.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{i}" for i in range(len(order))]
    rows = written(df.select("*", *[c.alias(k) for c, k in zip(order, keys)]), "unordered")
    up = [F.col(k).asc_nulls_first() for k in keys]
    ranges = rows.repartitionByRange(n, *up).sortWithinPartitions(*up).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rows = written(ranges.drop(*keys), "ordered")
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", before.alias("__start"))
    return rows.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def file_index(df: DataFrame, name: str = "place") -> DataFrame:
    """The places of rows that were read from files: by file, then as they lie in it."""
    meta = F.col("_metadata")
    return row_index(df.select("*", meta["file_path"].alias("__f"), meta["file_block_start"].alias("__s"), F.monotonically_increasing_id().alias("__m")), [F.col("__f"), F.col("__s"), F.col("__m")], name).drop("__f", "__s", "__m")


def joined_by_place(left: DataFrame, right: DataFrame, name: str = "place") -> DataFrame:
    """Two numbered tables side by side; raises ``ValueError`` where their lengths differ. Clashing names of ``right`` end in ``_right``."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows and {b} rows can't be joined by place")
    taken = {c.lower() for c in left.columns}
    names = {c: f"{c}_right" if c.lower() in taken and c != name else c for c in right.columns}
    return left.join(right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), name)
