"""Metrics of prepared rows: a registry of named columns, gated by what a table has, and means over conditions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ids(values: Column) -> Column:
    """Trimmed ids without blanks and nulls, each once, in order."""
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def recall(retrieved: Column, reference: Column, k: int | None = None) -> Column:
    """The share of the reference ids among the first ``k`` retrieved ones, or all; null without reference."""
    got, want = ids(retrieved), ids(reference)
    got = got if k is None else F.slice(got, 1, k)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(got, want)) / F.size(want))


def ndcg(retrieved: Column, reference: Column, k: int = 10) -> Column:
    """Gain of the first ``k`` retrieved ids, each found one counting 1 / log2(rank + 1), over the most that is possible; null without reference."""
    got, want = F.slice(ids(retrieved), 1, k), ids(reference)
    gains = F.transform(got, lambda x, i: F.when(F.array_contains(want, x), 1 / F.log2(i + 2)).otherwise(0.0))
    most = F.transform(F.sequence(F.lit(1), F.least(F.greatest(F.size(want), F.lit(1)), F.lit(k))), lambda i: 1 / F.log2(i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(want) > 0, total(gains) / total(most))


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` ids of each query, each once, ranked anew."""
    return hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("rank") <= k)


def _scored(relevant: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """From the relevant ones among the first (query_id, rank) and the sizes of the reference lists (query_id, size)."""
    found = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    most = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("size", F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return size.join(found, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("recall"), (F.coalesce("gain", F.lit(0.0)) / most).alias("ndcg"))


def retrieval_scores(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, ndcg) from tables (query_id, id, rank) and (query_id, id), for reference lists of any length.

    The first ``k`` ranks count, and an id once. Queries without relevant ids have no row.
    """
    want = relevant.select("query_id", "id").distinct()
    return _scored(_first(hits, k).join(want, ["query_id", "id"]), want.groupBy("query_id").agg(F.count(F.lit(1)).alias("size")), k)


def group_scores(hits: DataFrame, asked: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """``retrieval_scores`` where the ids of a query's groups are the relevant ones: asked (query_id, group), members (id, group).

    The reference lists aren't made, as all queries of a group have the same: ids are counted by the groups they are in,
    and only hits look for theirs.
    """
    asked, members = asked.select("query_id", "group").distinct(), members.select("id", "group").where("id is not null and group is not null").distinct()
    alike = members.groupBy("id").agg(F.array_sort(F.collect_set("group")).alias("groups")).groupBy("groups").agg(F.count(F.lit(1)).alias("n"))
    size = asked.join(alike.withColumn("group", F.explode("groups")), "group").select("query_id", "groups", "n").distinct().groupBy("query_id").agg(F.sum("n").alias("size"))
    relevant = _first(hits, k).join(asked, "query_id").join(members, ["id", "group"], "left_semi").select("query_id", "id", "rank").distinct()
    return _scored(relevant, size, k)


@dataclass(frozen=True)
class Metric:
    name: str
    required: frozenset[str]
    of: Callable[[], Column]


@dataclass
class Registry:
    """Metrics by name; a name is registered once unless it is meant to be replaced."""

    metrics: dict[str, Metric] = field(default_factory=dict)

    def register(self, name: str, required: Iterable[str], of: Callable[[], Column], replace: bool = False) -> None:
        if name in self.metrics and not replace:
            raise ValueError(f"a metric is already called {name}")
        self.metrics[name] = Metric(name, frozenset(required), of)

    def resolve(self, columns: Iterable[str], wanted: Sequence[str] | None = None, gate: bool = True) -> tuple[list[Metric], list[tuple[str, str]]]:
        """(metrics to compute, those left out and why). An unknown name raises ``KeyError``; so does, as ``ValueError``, a lacking column without ``gate``, or nothing being left."""
        names, have = list(self.metrics) if wanted is None else list(wanted), set(columns)
        if unknown := [n for n in names if n not in self.metrics]:
            raise KeyError(f"no metric is called {unknown[0]}; there are {', '.join(sorted(self.metrics))}")
        kept, left = [], []
        for m in (self.metrics[n] for n in names):
            if lacking := sorted(m.required - have):
                if not gate:
                    raise ValueError(f"{m.name} needs columns that are lacking: {', '.join(lacking)}")
                left.append((m.name, f"missing required columns: {', '.join(lacking)}"))
            else:
                kept.append(m)
        if not kept:
            raise ValueError("no metric has the columns that it needs")
        return kept, left

    def scored(self, rows: DataFrame, wanted: Sequence[str] | None = None, gate: bool = True) -> DataFrame:
        """``rows`` with a column a metric."""
        return rows.withColumns({m.name: m.of() for m in self.resolve(rows.columns, wanted, gate)[0]})


def standard() -> Registry:
    """Recall over all and nDCG of the first ten of ``retrieved_context_ids`` against ``reference_context_ids``."""
    out = Registry()
    pair = ("retrieved_context_ids", "reference_context_ids")
    out.register("retrieval_recall_at_k", pair, lambda: recall(*map(F.col, pair)))
    out.register("retrieval_ndcg_at_10", pair, lambda: ndcg(*map(F.col, pair)))
    return out


def condition_summary(rows: DataFrame, condition: str, failed: Column, registry: Registry, wanted: Sequence[str] | None = None) -> DataFrame:
    """Of every condition: rows, successes, failures, and the mean of each metric over its rows, numbers only; null without any."""
    kept, _ = registry.resolve(rows.columns, wanted)
    number = lambda m: F.when(~F.isnan(F.col(m.name).cast("double")), F.col(m.name).cast("double"))
    return registry.scored(rows, wanted).withColumn("__failed", F.coalesce(failed, F.lit(False))).groupBy(condition).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("__failed")).alias("success"), F.count_if("__failed").alias("failed"), *[F.avg(number(m)).alias(m.name) for m in kept]
    )
