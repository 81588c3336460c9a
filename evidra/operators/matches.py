"""All pairs of rows with equal keys, where a key has many rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bundle, and left bundles of a key that one task's share of the join holds.
BUNDLE, SHARE = 256, 16


def _bundles(rows: DataFrame, name: str) -> DataFrame:
    """(key, bundle, bundles, ``name``s): the values of a key by hash in bundles of some ``BUNDLE``, nulls kept."""
    rows = rows.where("key is not null")
    n = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUNDLE).alias("bundles"))
    placed = rows.join(n, "key").withColumn("bundle", F.pmod(F.xxhash64(name), F.col("bundles")))
    return placed.groupBy("key", "bundle").agg(F.first("bundles").alias("bundles"), F.collect_list(F.struct(name)).alias(f"{name}s"))


def pairs_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of (key, a) and (key, b) with equal keys, as the two values.

    A pair of bundles is joined once and opened where it is written: a value of ``right`` in a run, beside the same
    bundle of ``left`` again and again, which columnar files pack to a small part of what pairs in any order take. A key's
    bundles are dealt to several tasks, each of which gets all of its right ones.
    """
    a, b = (next(c for c in df.columns if c != "key") for df in (left, right))
    share = lambda x: F.floor(x / SHARE)
    mine = _bundles(left, a)
    shares = mine.groupBy("key").agg(F.first("bundles").alias("n"))
    other = _bundles(right, b).join(shares, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), share(F.col("n") - 1))).alias("share"), f"{b}s")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes here become very many rows
    dealt = lambda df: df.repartition(n, "key", "share")
    both = dealt(mine.withColumn("share", share(F.col("bundle")))).join(dealt(other), ["key", "share"])
    # as a lambda the first is opened row by row; else Spark holds all that a left bundle gives before it is written
    opened = both.select(f"{a}s", F.explode(F.transform(f"{b}s", lambda v: v[b])).alias(b)).select(F.explode(f"{a}s").alias("x"), b)
    return opened.select(F.col(f"x.{a}"), b)
