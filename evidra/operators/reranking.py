"""Reranking of retrieved candidates: weighted reciprocal ranks, and the validity-aware sum over them.

A query's candidates are what its retrievers returned, some dozens of rows, so windows by query are small.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions.rules import SPECIAL, families
from evidra.functions.values import parse_timestamp, text_set

#: The constant of reciprocal ranks; fields that are matched together.
RRF_K = 60
SCOPE = ("system_names", "partition_names", "service_names")
VERSION = ("module_names", "software_versions", "toolchain_versions")
FEATURES = ("authority", "scope", "software", "scope_family", "version", "status", "freshness")


def looked_up(key: Column, table: Mapping[str, float], default: float) -> Column:
    if not table:
        return F.lit(default)
    items = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(items, key), F.lit(default))


def merged(hits: DataFrame) -> DataFrame:
    """(query_id, id, source, rank, score) to one row a candidate: best rank in each source, best score, sources."""
    one = hits.groupBy("query_id", "id", "source").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    ranks = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank"))))  # as many as there are retrievers
    return one.groupBy("query_id", "id").agg(ranks.alias("source_ranks"), F.max("score").alias("best_score"), F.array_sort(F.collect_set("source")).alias("sources"))


def rrf(candidates: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Adds ``rrf`` and ``base_rank`` (by rrf, best score and id, all falling) to rows with ``source_ranks``."""
    part = lambda e: looked_up(e["key"], weights or {}, 1.0) / (k + e["value"])
    score = F.aggregate(F.map_entries("source_ranks"), F.lit(0.0), lambda a, e: a + part(e))
    order = W.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc_nulls_last("best_score"), F.desc("id"))
    return candidates.withColumn("rrf", score).withColumn("base_rank", F.row_number().over(order))


def rrf_rerank(candidates: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Adds ``place``: by rrf and best score falling, then id."""
    order = W.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc_nulls_last("best_score"), "id")
    return rrf(candidates, weights, k).withColumn("place", F.row_number().over(order))


def match(asked: Column, held: Column) -> Column:
    """1 where two sets meet, -1 where they don't, 0 where either is empty."""
    return F.when((F.size(asked) == 0) | (F.size(held) == 0), 0.0).when(F.arrays_overlap(asked, held), 1.0).otherwise(-1.0)


def _mean_match(fields: tuple[str, ...]) -> Column:
    """The mean over the fields that the query states; 0 if it states none."""
    stated = [F.size(f"q_{f}") > 0 for f in fields]
    total = sum((F.when(s, match(F.col(f"q_{f}"), F.col(f"c_{f}"))).otherwise(0.0) for s, f in zip(stated, fields)), F.lit(0.0))
    count = sum((s.cast("int") for s in stated), F.lit(0))
    return F.when(count == 0, 0.0).otherwise(total / count)


def validity_rerank(candidates: DataFrame, constraints: DataFrame, weights: Mapping[str, float], authority: Mapping[str, float], status: Mapping[str, float], source_weights: Mapping[str, float] | None = None, k: int = RRF_K, special: Mapping = SPECIAL) -> DataFrame:
    """Adds the features, ``final`` and ``place`` to candidates.

    ``candidates``: query_id, id, source_ranks, best_score, source_authority, validity_status, freshness_hint, and
    arrays named as in ``SCOPE`` and ``VERSION``, software_names and scope_family_names. ``constraints``: query_id and
    the same arrays, stated by the query; a query without a row states nothing. A query without software has no
    gate on its family; with software, a family counts only if the software matches and, unless the query names an
    exact scope, the candidate isn't of a special variant that the query doesn't name.
    """
    fields = (*SCOPE, *VERSION, "software_names", "scope_family_names")
    sets = lambda p: [text_set(F.col(f)).alias(f"{p}_{f}") for f in fields]
    asked = constraints.select("query_id", *sets("q"))
    rows = rrf(candidates, source_weights, k).select("*", *sets("c")).join(asked, "query_id", "left")
    rows = rows.withColumns({f"q_{f}": F.coalesce(f"q_{f}", F.array().cast("array<string>")) for f in fields})
    by = W.partitionBy("query_id")
    low, high = F.min("rrf").over(by), F.max("rrf").over(by)
    name = lambda c: F.lower(F.trim(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))))
    rows = rows.withColumn("semantic_base", F.when(high - low <= 1e-12, 1.0).otherwise((F.col("rrf") - low) / (high - low)))
    rows = rows.withColumn("authority_name", name("source_authority")).withColumn("at", parse_timestamp(F.col("freshness_hint")))
    dated = W.partitionBy("query_id", "authority_name", F.col("at").isNull())
    n, i = F.count(F.lit(1)).over(dated), F.row_number().over(dated.orderBy(F.desc("at"), F.desc("id")))
    fresh = F.when(F.col("at").isNull(), 0.0).when(n <= 1, 1.0).otherwise(1 - (i - 1) / (n - 1))
    variants = lambda p: families(F.concat_ws("\n", *[F.col(f"{p}_{f}") for f in (*SCOPE, "module_names")]), special)
    raw = match(F.col("q_scope_family_names"), F.col("c_scope_family_names"))
    software = match(F.col("q_software_names"), F.col("c_software_names"))
    exact = sum(((F.size(f"q_{f}") > 0).cast("int") for f in SCOPE), F.lit(0)) > 0
    other = F.size(F.array_except(F.array_intersect("q_scope_family_names", variants("c")), variants("q"))) > 0
    gate = F.when((raw <= 0) | (F.size("q_software_names") == 0), "applied").when(software <= 0, "blocked_no_software_match").when(~exact & other, "blocked_specialized_variant").otherwise("applied")
    rows = rows.withColumns({"authority": looked_up(F.col("authority_name"), authority, 0.0), "scope": _mean_match(SCOPE), "software": software, "version": _mean_match(VERSION), "status": looked_up(name("validity_status"), status, 0.0), "freshness": fresh, "gate": gate})
    rows = rows.withColumn("scope_family", F.when(F.col("gate") == "applied", raw).otherwise(0.0))
    rows = rows.withColumn("final", sum((F.lit(float(weights.get(f, 0.0))) * F.col(f) for f in FEATURES), F.col("semantic_base")))
    order = by.orderBy(F.desc("final"), F.desc("semantic_base"), "base_rank", "id")
    return rows.withColumn("place", F.row_number().over(order)).drop("authority_name", "at", *[f"{p}_{f}" for f in fields for p in "qc"])
