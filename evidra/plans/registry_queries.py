"""A registry made of parts as what documents say, with SQL of its own."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import registry as R


def candidates(spark: SparkSession, sf_dir: str, registry: int | None = None) -> DataFrame:
    """Parts as candidates: brands by three spellings, some with a status; brands whose numbers have the same last digit share an alias."""
    p = spark.read.parquet(os.path.join(sf_dir, "part.parquet"))
    if registry is not None:
        p = p.where(F.col("p_type") == "ECONOMY") if registry == 0 else p.where(F.col("p_type") != "ECONOMY")
    size, brand = F.col("p_size"), F.col("p_brand")
    name = F.when(size % 3 == 0, brand).when(size % 3 == 1, F.upper(F.replace(brand, F.lit("#"), F.lit(" ")))).otherwise(F.lower(F.replace(brand, F.lit("#"), F.lit("--"))))
    scope = F.when(size % 5 == 0, "local_official_services").when(size % 5 == 1, "external_official").otherwise("local_official")
    status = F.when(size == 10, "legacy").when(size % 10 == 1, "current").when((size == 20) & brand.endswith("2"), "eol").otherwise("unknown")
    line = F.concat(F.lit("Line "), F.substring(brand, -1, 1))
    return p.select(
        scope.alias("source_scope"), F.lower("p_type").alias("entity_type"), name.alias("canonical_name"), F.when(size == 7, F.array(line, F.lit(" "))).otherwise(F.array(name)).alias("aliases"),
        F.array(F.concat(size.cast("string"), F.lit(".0"))).alias("known_versions"), status.alias("status"), F.concat(F.lit("doc"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("doc_id"),
        F.col("p_name").alias("doc_title"), F.array("p_name").alias("heading_path"), F.col("p_name").alias("evidence_text"), F.when(size % 2 == 0, "table").otherwise("page").alias("extraction_method"),
    )


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(R.merged(candidates(spark, sf_dir)).entities.drop("heading_path"))


def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registries of economy parts and of all others as one."""
    out = R.across(*[R.merged(candidates(spark, sf_dir, i)) for i in (0, 1)])
    return _flat(out.entities.select("entity_id", "entity_type", "source_scope", "status", "review_state", "known_versions"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(R.merged(candidates(spark, sf_dir)).reviews.drop("notes"))


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(R.merged(candidates(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (entity_merge, registry_merge, review_queue, registry_summary)}
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_RANK = "CASE {} WHEN 'local_official' THEN 0 WHEN 'local_official_services' THEN 1 WHEN 'external_official' THEN 2 ELSE 9 END"
_MERGED = f"""c AS (
  SELECT CASE p_size % 5 WHEN 0 THEN 'local_official_services' WHEN 1 THEN 'external_official' ELSE 'local_official' END AS scope, lower(p_type) AS kind, p_name,
    CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(replace(p_brand, '#', ' ')) ELSE lower(replace(p_brand, '#', '--')) END AS name, p_size::VARCHAR || '.0' AS version, CASE WHEN p_size = 7 THEN 'Line ' || right(p_brand, 1) END AS line,
    CASE WHEN p_size = 10 THEN 'legacy' WHEN p_size % 10 = 1 THEN 'current' WHEN p_size = 20 AND p_brand LIKE '%2' THEN 'eol' ELSE 'unknown' END AS status, 'doc' || lpad(p_partkey::VARCHAR, 9, '0') AS doc, CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'page' END AS method
  FROM part
), g AS (
  SELECT CASE WHEN scope LIKE 'local%' THEN 'local' ELSE scope END AS g, kind, {_KEY.format('name')} AS k, count(*) AS n,
    first({{'scope': scope, 'name': name, 'doc': doc, 'title': p_name}} ORDER BY {_RANK.format('scope')}, scope, lower(name), doc) AS x,
    list_sort(list_distinct(list(status) FILTER (WHERE status <> 'unknown'))) AS st, list_sort(list_distinct(list(coalesce(line, name)))) AS al, list_sort(list_distinct(list(version))) AS ve, list_distinct(list(method)) AS me, list_sort(list_distinct(list(doc))) AS docs
  FROM c GROUP BY 1, 2, 3
), e AS (SELECT *, substr(sha1(x.scope || '|' || kind || '|' || k), 1, 16) AS id FROM g),
a AS (SELECT kind, {_KEY.format('alias')} AS ak, k, id, x, al FROM (SELECT *, unnest(al) AS alias FROM e)),
q AS (
  SELECT kind, ak, string_agg(x.name, ' / ' ORDER BY x.name) AS name, first(x.scope ORDER BY {_RANK.format('x.scope')}, x.scope) AS scope, count(*) AS n, list_sort(list_distinct(flatten(list(al)))) AS al, list_sort(list_distinct(list(x.doc))) AS docs, list(id) AS ids
  FROM a GROUP BY 1, 2 HAVING count(DISTINCT k) > 1
),
f AS (
  SELECT id AS entity_id, kind AS entity_type, x.name AS canonical_name, array_to_string(al, '|') AS aliases, x.scope AS source_scope, CASE WHEN len(st) = 1 THEN st[1] ELSE 'unknown' END AS status, array_to_string(ve, '|') AS known_versions, x.doc AS doc_id, x.title AS doc_title,
    CASE WHEN len(me) = 1 THEN me[1] ELSE 'merged' END AS extraction_method, CASE WHEN len(st) > 1 OR id IN (SELECT unnest(ids) FROM q) THEN 'needs_review' ELSE 'auto_verified' END AS review_state FROM e
),
r AS (
  SELECT 'conflicting_status' AS reason, kind AS entity_type, x.name AS canonical_name, x.scope AS source_scope, n AS candidate_count, array_to_string(st, '|') AS status_values, array_to_string(al, '|') AS aliases, array_to_string(docs, '|') AS doc_ids FROM e WHERE len(st) > 1
  UNION ALL SELECT 'alias_ambiguity', kind, name, scope, n, '', array_to_string(al, '|'), array_to_string(docs, '|') FROM q
)"""
# two registries: each merges its own candidates first, and a local entity's scope is that of its best candidate there
_ACROSS = f"""c AS (
  SELECT p_type = 'ECONOMY' AS part, CASE p_size % 5 WHEN 0 THEN 'local_official_services' WHEN 1 THEN 'external_official' ELSE 'local_official' END AS scope, lower(p_type) AS kind, {_KEY.format('p_brand')} AS k, p_size::VARCHAR || '.0' AS version,
    CASE WHEN p_size = 7 THEN 'line ' || right(p_brand, 1) ELSE {_KEY.format('p_brand')} END AS alias, CASE WHEN p_size = 10 THEN 'legacy' WHEN p_size % 10 = 1 THEN 'current' WHEN p_size = 20 AND p_brand LIKE '%2' THEN 'eol' ELSE 'unknown' END AS status FROM part
), g AS (
  SELECT part, kind, k, first(scope ORDER BY {_RANK.format('scope')}) AS scope, list_distinct(list(version)) AS ve, list_distinct(list(alias)) AS al, list_distinct(list(status) FILTER (WHERE status <> 'unknown')) AS st FROM c GROUP BY part, kind, k, scope = 'external_official'
), m AS (
  SELECT kind, k, scope, list_sort(list_distinct(flatten(list(ve)))) AS ve, list_distinct(flatten(list(al))) AS al, list_distinct(flatten(list(CASE WHEN len(st) = 1 THEN st ELSE [] END))) AS st FROM g GROUP BY 1, 2, 3
), d AS (SELECT kind, alias FROM (SELECT kind, k, unnest(al) AS alias FROM m) GROUP BY 1, 2 HAVING count(DISTINCT k) > 1)
SELECT substr(sha1(scope || '|' || kind || '|' || k), 1, 16) AS entity_id, kind AS entity_type, scope AS source_scope, CASE WHEN len(st) = 1 THEN st[1] ELSE 'unknown' END AS status,
  CASE WHEN len(st) > 1 OR EXISTS (SELECT 1 FROM d WHERE d.kind = m.kind AND list_contains(m.al, d.alias)) THEN 'needs_review' ELSE 'auto_verified' END AS review_state, array_to_string(ve, '|') AS known_versions FROM m"""
SQL = {
    "entity_merge": f"WITH {_MERGED} SELECT * FROM f",
    "registry_merge": f"WITH {_ACROSS}",
    "review_queue": f"WITH {_MERGED} SELECT * FROM r",
    "registry_summary": f"WITH {_MERGED} SELECT 'entity_count' AS measure, '' AS value, count(*) AS n FROM f UNION ALL SELECT 'review_count', '', count(*) FROM r UNION ALL SELECT 'counts_by_entity_type', entity_type, count(*) FROM f GROUP BY 2 "
    "UNION ALL SELECT 'counts_by_status', status, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'counts_by_source_scope', source_scope, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'counts_by_review_reason', reason, count(*) FROM r GROUP BY 2",
}
