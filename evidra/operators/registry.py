"""Entities of a registry from what documents say about them: merge, conflicts, review queue and artefact.

Candidates of one entity are aggregated where they lie before they meet, so an entity that every document names
is no burden; what they were read from stays a table of its own and is never gathered into a row.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.values import entity_id, key_of
from evidra.sources.shared import written

#: Scopes, the more trusted first, and those whose candidates are of one family.
SCOPES = ("local_official", "local_official_services", "external_official")
FAMILY, OTHER = "local_official_family", 9
CANDIDATE = "source_scope string, entity_type string, canonical_name string, aliases array<string>, known_versions array<string>, status string, doc_id string, doc_title string, heading_path array<string>, evidence_text string, extraction_method string"
EVIDENCE = ["doc_id", "doc_title", "heading_path", "evidence_text", "extraction_method"]


@dataclass
class Registry:
    """``entities``, one row each; ``evidence``, what each was read from; ``reviews``, what a person has to decide."""

    entities: DataFrame
    evidence: DataFrame
    reviews: DataFrame


def priority(scope: Column) -> Column:
    out = F.lit(OTHER)
    for i, s in reversed(list(enumerate(SCOPES))):
        out = F.when(scope == s, i).otherwise(out)
    return out


def _union(arrays: Column) -> Column:
    """Trimmed, without blanks, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(arrays), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def merged(candidates: DataFrame, across_registries: bool = False) -> Registry:
    """Candidates (columns of ``CANDIDATE``) of equal scope, type and name key as one entity.

    Local scopes are one scope, but for ``across_registries``, where entities of whole registries meet. The first
    candidate by scope, name and place names the entity; aliases and versions are united; a status holds if no other
    explicit one is there, else the entity is in the review queue, as are those that share an alias with another
    entity of their type. Null arrays are empty.
    """
    scope = F.col("source_scope")
    group = scope if across_registries else F.when(scope.isin(*SCOPES[:2]), FAMILY).otherwise(scope)
    none = F.array().cast("array<string>")
    rows = candidates.select(*[f.split()[0] for f in CANDIDATE.split(", ")], group.alias("__g"), F.col("entity_type").alias("__t"), key_of(F.col("canonical_name")).alias("__k"))
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("aliases", "known_versions", "heading_path")})
    first = F.struct(priority(scope).alias("p"), scope.alias("s"), F.lower("canonical_name").alias("n"), F.col("doc_id").alias("d"), F.col("heading_path").alias("h"), F.col("extraction_method").alias("m"))
    head = F.min_by(F.struct("source_scope", "canonical_name", "doc_id", "doc_title", "heading_path"), first)
    each = rows.groupBy("__g", "__t", "__k").agg(
        head.alias("x"), F.array_sort(F.collect_set(F.when(F.col("status") != "unknown", F.col("status")))).alias("statuses"), _union(F.collect_set("aliases")).alias("aliases"),
        _union(F.collect_set("known_versions")).alias("known_versions"), F.collect_set("extraction_method").alias("methods"), F.count(F.lit(1)).alias("n"),
    )
    each = written(each.select("*", entity_id(F.col("x.source_scope"), F.col("__t"), F.col("x.canonical_name")).alias("entity_id")), "entities")
    shared = each.select(F.col("__t").alias("entity_type"), "entity_id", F.col("x.canonical_name").alias("name"), F.col("x.source_scope").alias("scope"), F.col("x.doc_id").alias("doc"), "aliases", F.explode("aliases").alias("alias"))
    shared = shared.withColumn("alias_key", key_of(F.col("alias"))).where("alias_key <> ''")
    of_key = shared.groupBy("entity_type", "alias_key").agg(
        F.count_distinct(key_of(F.col("name"))).alias("names"), F.array_join(F.array_sort(F.collect_list("name")), " / ").alias("canonical_name"), F.min_by("scope", F.struct(priority(F.col("scope")), "scope")).alias("source_scope"),
        F.count(F.lit(1)).alias("candidate_count"), _union(F.collect_set("aliases")).alias("aliases"), F.array_sort(F.collect_set("doc")).alias("doc_ids"), F.collect_set("entity_id").alias("ids"),
    ).where("names > 1")
    doubtful = of_key.select(F.explode("ids").alias("entity_id")).distinct().withColumn("doubtful", F.lit(True))
    conflict = F.size("statuses") > 1
    entities = each.join(doubtful, "entity_id", "left").select(
        "entity_id", F.col("__t").alias("entity_type"), "x.canonical_name", "aliases", "x.source_scope", F.when(F.size("statuses") == 1, F.col("statuses")[0]).otherwise("unknown").alias("status"), "known_versions",
        "x.doc_id", "x.doc_title", "x.heading_path", F.when(F.size("methods") == 1, F.col("methods")[0]).otherwise("merged").alias("extraction_method"),
        F.when(conflict | F.coalesce("doubtful", F.lit(False)), "needs_review").otherwise("auto_verified").alias("review_state"),
    )
    key = ["__g", "__t", "__k"]
    docs = rows.join(each.where(conflict).select(*key), key).groupBy(*key).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    conflicts = each.where(conflict).join(docs, key).select(
        F.lit("conflicting_status").alias("reason"), F.col("__t").alias("entity_type"), "x.canonical_name", "x.source_scope", F.col("n").alias("candidate_count"), F.col("statuses").alias("status_values"), "aliases", "doc_ids",
        F.lit("Multiple explicit lifecycle statuses for the same entity.").alias("notes"),
    )
    ambiguous = of_key.select(
        F.lit("alias_ambiguity").alias("reason"), "entity_type", "canonical_name", "source_scope", "candidate_count", none.alias("status_values"), "aliases", "doc_ids",
        F.concat(F.lit("Alias key '"), "alias_key", F.lit("' maps to multiple entities of the same type.")).alias("notes"),
    )
    evidence = rows.join(each.select(*key, "entity_id"), key).select("entity_id", *EVIDENCE).distinct()
    return Registry(entities, evidence, conflicts.unionByName(ambiguous))


def across(*registries: Registry) -> Registry:
    """Registries as one: the entities of each are candidates, and all evidence stays."""
    whole = registries[0].entities
    proof = registries[0].evidence
    for r in registries[1:]:
        whole, proof = whole.unionByName(r.entities), proof.unionByName(r.evidence)
    out = merged(whole.withColumn("evidence_text", F.lit("")), across_registries=True)
    names = whole.select(F.col("entity_id").alias("old"), "source_scope", "entity_type", key_of(F.col("canonical_name")).alias("k")).distinct()
    new = out.entities.select("entity_id", "source_scope", "entity_type", key_of(F.col("canonical_name")).alias("k"))
    moved = names.join(new, ["source_scope", "entity_type", "k"]).select("old", "entity_id")
    return Registry(out.entities, proof.withColumnRenamed("entity_id", "old").join(moved, "old").select("entity_id", *EVIDENCE).distinct(), out.reviews)


def summary(registry: Registry) -> DataFrame:
    """(measure, value, n): all entities and reviews, and entities by type, status and scope, reviews by reason."""
    by = lambda df, c, name: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "value", "n")
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("value"), "n")
    e, r = registry.entities, registry.reviews
    out = total(e, "entity_count").unionByName(total(r, "review_count"))
    for c in ("entity_type", "status", "source_scope"):
        out = out.unionByName(by(e, c, f"counts_by_{c}"))
    return out.unionByName(by(r, "reason", "counts_by_review_reason"))


def write_reviews(reviews: DataFrame, path: str) -> None:
    """The review queue as CSV; lists are joined by bars."""
    lists = [f.name for f in reviews.schema.fields if f.dataType.typeName() == "array"]
    reviews.withColumns({c: F.concat_ws("|", c) for c in lists}).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_registry(registry: Registry, path: str, build: Mapping[str, object], documents: DataFrame | None = None) -> None:
    """A folder: entities, evidence and reviews, the documents (url, source_scope) if given, and ``build`` with sorted keys, written last."""
    for name in ("entities", "evidence", "reviews"):
        getattr(registry, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = registry.entities.sparkSession
    if documents is not None:
        documents.select("url", "source_scope").write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame([(json.dumps({"documents": documents is not None, **build}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/build")


def read_registry(spark: SparkSession, path: str) -> tuple[Registry, dict, DataFrame]:
    """(registry, build, documents). Where no documents were written, they are those of the evidence, of the build's scope."""
    build = json.loads(spark.read.text(f"{path}/build").first()[0])
    r = Registry(*[spark.read.parquet(f"{path}/{n}") for n in ("entities", "evidence", "reviews")])
    scope = str(build.get("source_scope") or SCOPES[0])
    docs = spark.read.parquet(f"{path}/documents") if build.get("documents") else r.evidence.select(F.col("doc_id").alias("url"), F.lit(scope).alias("source_scope")).distinct()
    return r, build, docs
