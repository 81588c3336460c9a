"""Development and test parts in which every label value has its share.

Rows of equal labels can stand for each other, so the search is over how many rows of each kind of row go to
the test part: its size depends on the values that labels take, not on the rows. Restarts are tasks of their
own; the best one's counts are then drawn from each kind, by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidra.sources.shared import written

#: Fixed value: what a wanted label value costs that the test part lacks.
ABSENT = 100.0
KICKS = 12
#: Kinds of rows that a search takes: labels are of closed domains.
MOST_KINDS = 20_000


def resolved_size(rows: int, size: int | None = None, fraction: float | None = None) -> int:
    """The rows of the test part; a half of a row goes to the even number. Raises ``ValueError`` where either part would be empty."""
    if rows < 2:
        raise ValueError("two rows or more are needed for two parts")
    if (size is None) == (fraction is None):
        raise ValueError("either a size or a fraction is needed")
    if fraction is not None and not 0 < fraction < 1:
        raise ValueError(f"the fraction is between 0 and 1, not {fraction}")
    out = round(rows * fraction) if fraction is not None else int(size)
    if not 0 < out < rows:
        raise ValueError(f"the test part has between 1 and {rows - 1} rows, not {out}")
    return out


def targets(totals: np.ndarray, size: int, rows: int) -> np.ndarray:
    return np.array([round(int(t) * size / rows) for t in totals], np.int64)


def score(counts: np.ndarray, goal: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Squared misses over totals, and ``ABSENT`` for each value that is wanted and absent; of each row of ``counts``."""
    return ((counts - goal) ** 2 / np.maximum(totals, 1)).sum(-1) + ABSENT * ((goal > 0) & (counts == 0)).sum(-1)


def searched(has: np.ndarray, held: np.ndarray, size: int, seed: int) -> tuple[float, np.ndarray]:
    """(score, rows taken of each kind) of one start; ``has``: kinds by label values, ``held``: rows of each kind.

    Every kind starts with its whole share; the rest goes one by one to the kind that fills most of what is lacking,
    kinds in an order drawn by ``seed``; then the best exchange of two rows is made as long as one betters the score. ``KICKS`` times two rows are
    exchanged by chance and the descent is made again, which leaves hollows that are not the deepest.
    """
    rng = np.random.default_rng(seed)
    rows, order = int(held.sum()), rng.permutation(len(held))
    totals = held @ has
    goal = targets(totals, size, rows)
    taken = held * size // rows
    weight = 1 / np.maximum(totals, 1)
    while taken.sum() < size:
        lack = np.maximum(goal - taken @ has, 0)
        gain = (has * np.where(lack > 0, lack + weight, 0)).sum(1)
        over = (has * np.where(lack > 0, 0, weight)).sum(1)
        free = order[taken[order] < held[order]]
        taken[max(free, key=lambda k: (gain[k], -over[k]))] += 1
    best = _descended(has, held, taken, goal, totals)
    for _ in range(KICKS):
        if best[0] <= 0:
            break
        taken = best[1].copy()
        for _ in range(2):
            out, into = rng.choice(np.flatnonzero(taken > 0)), rng.choice(np.flatnonzero(taken < held))
            taken[out] -= 1
            taken[into] += 1
        got = _descended(has, held, taken, goal, totals)
        best = got if got[0] < best[0] - 1e-12 else best
    return best


def _descended(has: np.ndarray, held: np.ndarray, taken: np.ndarray, goal: np.ndarray, totals: np.ndarray) -> tuple[float, np.ndarray]:
    now = float(score(taken @ has, goal, totals))
    while True:
        counts = taken @ has
        best = (now - 1e-12, -1, -1)
        into = np.flatnonzero(taken < held)
        for out in np.flatnonzero(taken > 0):
            values = score(counts - has[out] + has[into], goal, totals)
            i = int(values.argmin())
            best = min(best, (float(values[i]), int(into[i]), int(out)))
        if best[1] < 0:
            return now, taken
        now = best[0]
        taken[best[1]] += 1
        taken[best[2]] -= 1


def multilabel_split(rows: DataFrame, key: str, labels: Sequence[str], size: int | None = None, fraction: float | None = None, seed: int = 42, restarts: int = 8) -> DataFrame:
    """``rows`` with ``split``, ``test`` or ``dev``. Null labels are a value, the same as blank ones; keys are distinct."""
    spark = rows.sparkSession
    value = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"^\s+|\s+$", "")
    marked = written(rows.withColumn("__kind", F.array(*[value(c) for c in labels])), "split-rows")
    kinds = written(marked.groupBy("__kind").agg(F.count(F.lit(1)).alias("held")), "split-kinds")
    n, many = kinds.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count(F.lit(1))).first()
    if many > MOST_KINDS:
        raise ValueError(f"{many} kinds of rows; these columns are no labels")
    wanted = resolved_size(n, size, fraction)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for restart in pdf["restart"]:
                found, taken = searched(has, held, wanted, seed + int(restart))
                yield pd.DataFrame({"score": [found], "taken": [taken.tolist()]})

    # at most MOST_KINDS rows of label values: they travel with the function
    table = sorted((tuple(r["__kind"]), r["held"]) for r in kinds.collect())
    held = np.array([h for _, h in table], np.int64)
    values = {v: i for i, v in enumerate(sorted({(j, v) for kind, _ in table for j, v in enumerate(kind)}))}
    has = np.zeros((len(table), len(values)), np.int64)
    for k, (kind, _) in enumerate(table):
        has[k, [values[j, v] for j, v in enumerate(kind)]] = 1
    starts = spark.range(restarts, numPartitions=max(1, restarts)).withColumnRenamed("id", "restart")
    best = starts.mapInPandas(search, "score double, taken array<long>").agg(F.min(F.struct("score", "taken")).alias("b")).first()["b"]["taken"]
    take = spark.createDataFrame([(list(kind), int(t)) for (kind, _), t in zip(table, best)], "__kind array<string>, __take long")
    # a kind can hold most rows: its smallest hashes are found by counting hashes in ranges first
    drawn = marked.withColumn("__h", F.xxhash64(F.lit(seed), F.col(f"`{key}`"))).withColumn("__range", F.shiftright("__h", 48))
    ranges = drawn.groupBy("__kind", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("__kind").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("__before", before).join(take, "__kind").select("__kind", "__range", "__before", "__take")
    place = F.row_number().over(W.partitionBy("__kind", "__range").orderBy("__h", F.col(f"`{key}`")))
    placed = drawn.withColumn("__place", place).join(ranges, ["__kind", "__range"])
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("__before") + F.col("__place") <= F.col("__take"), "test").otherwise("dev").alias("split"))
