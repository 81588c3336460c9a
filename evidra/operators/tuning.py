"""Weights of the validity reranker, tried against judged queries.

The score is linear in the weights, so one pass over the candidates' features serves all trials: a task holds
one query's candidates at a time, scores them under every weight vector at once, and adds up what each trial's
ranking is worth; it gives one row a trial, however many queries it read. Sums are whole numbers, so neither
their order nor the number of tasks can change which trial is best.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidra.operators.reranking import FEATURES

#: The weights that are tried, whole, in the first of two phases, and around what that found.
GRID = {"authority": (0.00, 0.04, 0.08), "scope": (0.00, 0.04, 0.08), "software": (0.00,), "scope_family": (0.00,), "version": (0.00,), "status": (0.00, 0.04, 0.08), "freshness": (0.00, 0.01)}
CORE_GRID = {"authority": (0.04, 0.08), "scope": (0.00, 0.04, 0.08), "software": (0.00,), "scope_family": (0.00,), "version": (0.00,), "status": (0.04, 0.08), "freshness": (0.00, 0.01)}
SECOND_GRID = {"freshness": (0.00, 0.005, 0.01), "software": (0.00, 0.04), "scope_family": (0.00, 0.02), "version": (0.00, 0.04)}
#: What tells anchors apart, and how many prepared rows a trial needs.
ANCHOR = ("authority", "scope", "status")
LEAST_ROWS = 60
#: A metric is added up in steps of 2 ** -STEP.
STEP = 40


def grid_trials(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    names = sorted(grid)
    return [dict(zip(names, map(float, v))) for v in product(*(grid[n] for n in names))]


def distinct_trials(trials: Sequence[Mapping[str, float]]) -> list[dict[str, float]]:
    """Each weight vector once, first ones first; a feature that isn't named weighs nothing."""
    full = [{f: float(t.get(f, 0.0)) for f in FEATURES} for t in trials]
    return list({tuple(sorted(t.items())): t for t in reversed(full)}.values())[::-1]


def first_trials(profile: str = "full") -> list[dict[str, float]]:
    """``full``, or for ``core`` and ``two_phase`` no weights at all and the core grid."""
    if profile not in ("full", "core", "two_phase"):
        raise ValueError(f"no grid is called {profile}")
    return distinct_trials(grid_trials(GRID) if profile == "full" else [{}, *grid_trials(CORE_GRID)])


def second_trials(anchors: Sequence[Mapping[str, float]]) -> list[dict[str, float]]:
    return distinct_trials([{a: anchor[a] for a in ANCHOR} | t for anchor in anchors for t in grid_trials(SECOND_GRID)])


def offline_trials(ranked: DataFrame, relevant: DataFrame, trials: Sequence[Mapping[str, float]], k: int = 10) -> DataFrame:
    """(trial, the weights, prepared_rows, recall, ndcg, objective) of every trial.

    ``ranked``: what ``validity_rerank`` gives, under any weights; ``relevant``: (query_id, id). Queries with a relevant
    candidate count. ``recall`` is the share of a query's relevant candidates among the first ``k``, ``ndcg`` that of
    their gain by rank; both are means over queries and ``objective`` is their mean. Ties go as in the reranker.
    """
    weights = np.array([[t.get(f, 0.0) for f in FEATURES] for t in trials])
    judged = relevant.select("query_id", "id").distinct().withColumn("__hit", F.lit(True))
    rows = ranked.select("query_id", "id", "semantic_base", "base_rank", *FEATURES).join(judged, ["query_id", "id"], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    order = ["query_id", F.desc("semantic_base"), "base_rank", "id"]
    rows = rows.repartition("query_id").sortWithinPartitions(*order).select(F.col("query_id").cast("string").alias("q"), "semantic_base", *FEATURES, "__hit")
    gains = 1 / np.log2(np.arange(k) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, sums = 0, np.zeros((len(weights), 2), np.int64)

        def add(parts: list[pa.RecordBatch]) -> None:
            nonlocal queries
            t = pa.Table.from_batches(parts)
            hit = t["__hit"].to_numpy(zero_copy_only=False)
            if not hit.any():
                return
            queries += 1
            score = np.repeat(t["semantic_base"].to_numpy()[None], len(weights), 0)
            for j, f in enumerate(FEATURES):  # added up one by one, as the reranker does
                score = score + weights[:, j : j + 1] * t[f].to_numpy()[None]
            first = hit[np.argsort(-score, axis=1, kind="stable")[:, :k]]
            n = int(hit.sum())
            recall = first.sum(1) / n
            ndcg = (first * gains[: first.shape[1]]).sum(1) / gains[: min(n, k)].sum()
            sums[:] += np.rint(np.stack([recall, ndcg], 1) * 2.0**STEP).astype(np.int64)

        held, last = [], None
        for b in batches:
            q = b.column("q").to_pylist()
            start = 0
            for i in range(1, len(q) + 1):
                if i < len(q) and q[i] == q[start]:
                    continue
                if held and q[start] != last:
                    add(held)
                    held = []
                held.append(b.slice(start, i - start))
                last, start = q[start], i
        if held:
            add(held)
        n = len(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, queries)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["trial", "queries", "recall", "ndcg"])

    spark = ranked.sparkSession
    each = rows.mapInArrow(run, "trial long, queries long, recall long, ndcg long").groupBy("trial").agg(F.sum("queries").alias("prepared_rows"), F.sum("recall").alias("recall"), F.sum("ndcg").alias("ndcg"))
    mean = lambda c: F.when(F.col("prepared_rows") > 0, F.col(c) / F.col("prepared_rows") / float(1 << STEP)).alias(c)
    named = spark.createDataFrame([(i, *[float(t.get(f, 0.0)) for f in FEATURES]) for i, t in enumerate(trials)], "trial long, " + ", ".join(f"{f} double" for f in FEATURES))
    out = named.join(each, "trial", "left").select("trial", *FEATURES, F.coalesce("prepared_rows", F.lit(0)).alias("prepared_rows"), mean("recall"), mean("ndcg"))
    return out.withColumn("objective", objective("recall", "ndcg"))


def objective(*metrics: str) -> F.Column:
    """The mean of those metrics that are numbers; minus infinity without any."""
    usable = F.filter(F.array(*[F.col(m).cast("double") for m in metrics]), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(usable) == 0, F.lit(float("-inf"))).otherwise(F.aggregate(usable, F.lit(0.0), lambda a, x: a + x) / F.size(usable))


def _low(metric: str) -> F.Column:
    return F.coalesce(F.nanvl(F.col(metric).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))


def ordering(precision: str, faithfulness: str, core: Sequence[str] = (), least_rows: int | None = None) -> list[F.Column]:
    """Best first: the objective, then the two metrics, little weight, and the weights by name. With ``least_rows``, trials with so many come first, by the mean of ``core`` and ``precision``."""
    total = sum((F.col(f) for f in FEATURES), F.lit(0.0))
    tie = [_low(precision).desc(), _low(faithfulness).desc(), total.asc(), *[F.col(f).desc() for f in sorted(FEATURES)]]
    if least_rows is None:
        return [F.col("objective").desc(), *tie]
    return [(F.col("prepared_rows") >= least_rows).desc(), objective(*core).desc(), _low(precision).desc(), F.col("objective").desc(), *tie]


def best_trial(trials: DataFrame, order: Sequence[F.Column]) -> DataFrame:
    if trials.isEmpty():
        raise ValueError("there are no trials")
    return trials.orderBy(*order).limit(1)


def anchor_trials(trials: DataFrame, order: Sequence[F.Column], n: int = 2, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The best trials of ``n`` different (authority, scope, status), among those with rows enough if there are any."""
    covered = trials.where(F.col("prepared_rows") >= least_rows)
    pool = trials if covered.isEmpty() else covered
    first = pool.withColumn("__n", F.row_number().over(W.partitionBy(*ANCHOR).orderBy(*order))).where("__n = 1").drop("__n")
    return first.orderBy(*order).limit(max(1, n))
