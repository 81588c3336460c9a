"""Connected components of a link table, with the smallest id of each as its name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written


def stars(links: DataFrame) -> DataFrame:
    """Links of one task as stars around their smallest ids; a task's ids bound its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = up.get(p, p)
                x = p
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    up.setdefault(min(x, y), min(x, y))
        rows = [(x, r) for x in up if (r := root(x)) != x]
        for s in range(0, len(rows), 10_000):
            part = rows[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (id, component) of every id that has a link; larger and smaller stars alternate until nothing moves."""
    edges = written(stars(links.select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct(), "component-links")  # u > v

    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = low(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "component-large")
        mins = low(large)
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        new = written(stars(small.where("u != v").select("u", "v")).distinct(), "component-small")
        moved = new.exceptAll(edges).limit(1).count() or edges.exceptAll(new).limit(1).count()
        edges = new
        if not moved:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
