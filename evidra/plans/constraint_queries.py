"""Questions made of the orders table, read by a registry made of parts, nations and regions, with SQL of their own.

Both engines also get ``ENTITIES`` and ``QUESTIONS``, which show what the tables' names can't: families of partitions
and names that only their surroundings tell apart.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import constraints as C
from evidra.plans.rule_queries import _FAMILY, _sql_list

ENTITIES = [
    ("software-gromacs", "software", "GROMACS", "gromacs", "2024.4"), ("module-gromacs", "module", "gromacs/2024.4", "gromacs/2024.4", "2024.4"), ("toolchain-cuda", "toolchain", "cuda/12.1", "cuda/12.1", "12.1"),
    ("partition-cclake", "partition", "cclake", "cclake", None), ("system-cclake", "system", "Cascade Lake Nodes", "cclake", None), ("module-base", "module", "rhel8/cclake/base", "rhel8/cclake/base", None),
]
QUESTIONS = [
    (-1, "How do I run GROMACS 2024.4 on cclake?"), (-2, "sbatch -p cclake run_job.sh"), (-3, "Which cclake nodes should I use?"), (-4, "What documentation exists on cclake?"),
    (-5, "module load rhel8/cclake/base gromacs/2024.4 cuda/12.1"), (-6, "Can I use cclake?"), (-7, "  "), (-8, "Is gromacs1 or xgromacs compatible?"),
]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    brands = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.concat(F.col("p_size").cast("string"), F.lit(".1")))).alias("v"))
    spaced, even = F.replace("p_brand", F.lit("#"), F.lit(" ")), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 2 == 0
    software = brands.select(F.concat(F.lit("software-"), "p_brand").alias("entity_id"), F.lit("software").alias("entity_type"), F.col("p_brand").alias("canonical_name"), F.array(spaced).alias("aliases"), F.col("v").alias("known_versions"))
    modules = brands.select(F.concat(F.lit("module-"), "p_brand"), F.lit("module"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))), F.when(even, F.array(spaced)).otherwise(none), none)
    n = _t(spark, sf_dir, "nation")
    partitions = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("partition-"), "n_name"), F.lit("partition"), "n_name", none, none)
    systems = n.select(F.concat(F.lit("system-"), "n_name"), F.lit("system"), F.concat("n_name", F.lit(" Nodes")), F.array("n_name"), none)
    services = _t(spark, sf_dir, "region").select(F.concat(F.lit("service-"), "r_name"), F.lit("service"), "r_name", none, none)
    made = spark.createDataFrame(ENTITIES, "entity_id string, entity_type string, canonical_name string, a string, v string").select("entity_id", "entity_type", "canonical_name", F.array("a"), F.array_compact(F.array("v")))
    return software.union(modules).union(partitions).union(systems).union(services).union(made)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 25).alias("n_nationkey"), (F.col("o_custkey") % 200).alias("p_partkey"))
    parts = F.broadcast(_t(spark, sf_dir, "part").where("p_partkey between -199 and 199"))  # all that a remainder can name
    o = o.join(_t(spark, sf_dir, "nation"), "n_nationkey").join(parts, "p_partkey").join(_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    kind = F.col("o_orderkey") % 8
    texts = [
        F.concat(F.lit("sbatch -p "), "n_name", F.lit(" job.sh")), F.concat(F.lit("How do I run "), "p_brand", F.lit(" "), "p_size", F.lit(".1 on "), "n_name", F.lit("?")),
        F.concat(F.lit("Which "), "n_name", F.lit(" nodes should I use?")), F.concat(F.lit("module load "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/")))),
        F.concat(F.lit("Is "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" the latest version?")), F.concat(F.lit("Can I use "), "n_name", F.lit("?")),
        F.concat(F.lit("What is the quota in "), F.lower("r_name"), F.lit("?")), F.concat("o_orderpriority", F.lit(" order of "), "p_size", F.lit(".2")),
    ]
    text = F.element_at(F.array(*texts), (kind + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("query_id"), text.alias("text")).unionByName(spark.createDataFrame(QUESTIONS, "query_id long, text string"))


def query_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.query_constraints(questions(spark, sf_dir), registry(spark, sf_dir))
    return out.select("query_id", *[F.array_join(c, "|").alias(c) if c.endswith(("names", "versions")) else F.col(c) for c in C.COLUMNS])


def alias_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.alias_context(questions(spark, sf_dir), registry(spark, sf_dir))
    return out.select("query_id", "alias", "reading", F.array_join(F.array_sort("entity_ids"), "|").alias("entity_ids"), F.array_join("families", "|").alias("families"))


QUERIES = {f.__name__: f for f in (query_constraints, alias_context)}
_REGISTRY = f"""b AS (SELECT p_brand, replace(p_brand, '#', ' ') AS spaced, list_sort(list_distinct(list(p_size || '.1'))) AS v FROM part GROUP BY 1),
e AS (
  SELECT 'software-' || p_brand AS id, 'software' AS kind, p_brand AS name, [spaced] AS aliases, v FROM b
  UNION ALL SELECT 'module-' || p_brand, 'module', lower(replace(p_brand, '#', '/')), CASE WHEN regexp_extract(p_brand, '[0-9]+$')::INT % 2 = 0 THEN [spaced] ELSE [] END, [] FROM b
  UNION ALL SELECT 'partition-' || n_name, 'partition', n_name, [], [] FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'system-' || n_name, 'system', n_name || ' Nodes', [n_name], [] FROM nation UNION ALL SELECT 'service-' || r_name, 'service', r_name, [], [] FROM region
  UNION ALL SELECT id, kind, name, [a], CASE WHEN v IS NULL THEN [] ELSE [v] END FROM {_sql_list(ENTITIES, 'id, kind, name, a, v')}
),
fam AS (SELECT e.id, list_sort(list(f.family)) AS fams FROM e, (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _FAMILY.items())}) f(family, names)
  WHERE regexp_matches(e.name || ' ' || array_to_string(e.aliases, ' '), '(?i)\\b(' || names || ')\\b') GROUP BY 1),
a AS (SELECT DISTINCT id, kind, lower(trim(x)) AS alias FROM (SELECT id, kind, unnest(list_concat([name], aliases)) AS x FROM e)),
g AS (SELECT alias, count(*) AS n, bool_and(kind IN ('partition', 'system')) AS scope, bool_or(kind = 'software') AND bool_and(kind IN ('software', 'module', 'toolchain')) AS tools FROM a GROUP BY 1),
q AS (
  SELECT o_orderkey AS query_id, CASE o_orderkey % 8 WHEN 0 THEN 'sbatch -p ' || n_name || ' job.sh' WHEN 1 THEN 'How do I run ' || p_brand || ' ' || p_size || '.1 on ' || n_name || '?' WHEN 2 THEN 'Which ' || n_name || ' nodes should I use?'
    WHEN 3 THEN 'module load ' || lower(replace(p_brand, '#', '/')) WHEN 4 THEN 'Is ' || replace(p_brand, '#', ' ') || ' the latest version?' WHEN 5 THEN 'Can I use ' || n_name || '?' WHEN 6 THEN 'What is the quota in ' || lower(r_name) || '?'
    ELSE o_orderpriority || ' order of ' || p_size || '.2' END AS text
  FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 JOIN part ON p_partkey = o_custkey % 200 JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT query_id, text FROM {_sql_list(QUESTIONS, 'query_id, text')}
),
u AS MATERIALIZED (SELECT text, lower(text) AS low FROM q GROUP BY 1),
uh AS MATERIALIZED (SELECT text, low, alias FROM u JOIN (SELECT DISTINCT alias FROM g) k ON contains(low, alias)),
h AS (
  SELECT query_id, text, alias, p FROM q JOIN (
    SELECT text, alias, length(regexp_extract(low, '(?s)^(.*?(?:^|[^a-z0-9]))' || regexp_escape(alias) || '(?:[^a-z0-9]|$)', 1)) AS p
    FROM uh WHERE regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(alias) || '([^a-z0-9]|$)')) USING (text)
),
w AS (SELECT h.*, n, scope, tools, substr(text, greatest(p - 28, 0) + 1, p + length(alias) + 28 - greatest(p - 28, 0)) AS near, substr(text, greatest(p - 32, 0) + 1, p + length(alias) + 32 - greatest(p - 32, 0)) AS wide FROM h JOIN g USING (alias)),
r AS (
  SELECT *, CASE WHEN n = 1 THEN 'only'
    WHEN scope THEN CASE WHEN regexp_matches(near, '(?i)\\b(partition|queue|sbatch|srun|salloc)\\b|--partition|(^|\\W)-p\\b') THEN 'partition' WHEN regexp_matches(near, '(?i)\\b(node|nodes|system|cluster)\\b') THEN 'system' ELSE 'open' END
    WHEN tools THEN CASE WHEN regexp_matches(near, '(?i)\\b(module|modules|spack)\\b') THEN 'module' ELSE 'software' END ELSE 'open' END AS reading FROM w
),
m AS (SELECT r.query_id, r.alias, a.id FROM r JOIN a ON a.alias = r.alias AND (reading = 'only' OR reading = kind OR (reading = 'module' AND kind = 'toolchain'))),
z AS (
  SELECT query_id, alias, id FROM m
  UNION ALL SELECT r.query_id, r.alias, a.id FROM r JOIN a USING (alias) WHERE scope AND NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = r.query_id AND m.alias = r.alias)
    AND NOT regexp_matches(wide, '(?i)\\b(partition|queue|sbatch|srun|salloc|node|nodes|system|cluster)\\b|--partition|(^|\\W)-p\\b')
    AND regexp_matches(wide, '(?i)\\b(run|running|submit|submitting|launch|launching|execute|executing|compile|compiling|build|building|install|installing|use|using|develop|development|jobs?)\\b')
),
zf AS (SELECT query_id, alias, unnest(fams) AS f FROM z JOIN fam USING (id))"""
_NAMES = ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE kind = '{k}'))), '|'), '') AS {n}" for k, n in C.NAMES.items())
_VERSIONS = ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(flatten(list(seen) FILTER (WHERE kind = '{k}')))), '|'), '') AS {n}" for k, n in C.VERSIONS.items())
SQL = {
    "alias_context": f"WITH {_REGISTRY} SELECT r.query_id, r.alias, reading, coalesce((SELECT string_agg(id, '|' ORDER BY id) FROM m WHERE m.query_id = r.query_id AND m.alias = r.alias), '') AS entity_ids, "
    "coalesce((SELECT string_agg(DISTINCT f, '|' ORDER BY f) FROM zf WHERE zf.query_id = r.query_id AND zf.alias = r.alias), '') AS families FROM r",
    "query_constraints": f"""WITH {_REGISTRY},
kv AS (SELECT DISTINCT unnest(v) AS v FROM e),
ov AS (SELECT text, list(v) AS held FROM (SELECT text, v FROM u JOIN kv ON contains(text, v)) WHERE regexp_matches(text, '(^|[^A-Za-z0-9])' || regexp_escape(v) || '([^A-Za-z0-9]|$)') GROUP BY 1),
o AS (
  SELECT query_id, text, list_concat(regexp_extract_all(text, '\\b[0-9]+[.][0-9]+(?:[.][0-9]+)?(?:[.][0-9]+)?(?:[-+_][A-Za-z0-9][A-Za-z0-9.+_-]*)?\\b'), coalesce(held, [])) AS observed
  FROM q LEFT JOIN ov USING (text)
),
t AS (SELECT query_id, unnest(string_split(regexp_extract(text, '(?im)^\\s*module\\s+load\\s+([^\\n#;]+)', 1), ' ')) AS token FROM q),
c AS (
  SELECT query_id, id FROM m UNION SELECT query_id, a.id FROM t JOIN a ON a.alias = lower(token)
  UNION SELECT q.query_id, a.id FROM q JOIN a ON kind = 'partition' AND alias = lower(regexp_extract(text, '-p\\s+([A-Za-z0-9][A-Za-z0-9_-]*)', 1))
),
ce AS (SELECT c.query_id, e.*, list_filter(e.v, lambda x: list_contains(o.observed, x)) AS seen FROM c JOIN e USING (id) JOIN o USING (query_id)),
f AS (SELECT query_id, f FROM zf UNION SELECT query_id, unnest(fams) FROM c JOIN fam USING (id) UNION SELECT query_id, 'cclake' FROM t WHERE token LIKE '%/cclake/%'),
fs AS (SELECT query_id, string_agg(f, '|' ORDER BY f) AS scope_family_names FROM f GROUP BY 1),
n AS (SELECT query_id, {_NAMES}, {_VERSIONS} FROM ce GROUP BY 1),
x AS (
  SELECT o.query_id, text, observed, {', '.join(f"coalesce({n}, '') AS {n}" for n in (*C.NAMES.values(), *C.VERSIONS.values(), 'scope_family_names'))} FROM o LEFT JOIN n USING (query_id) LEFT JOIN fs USING (query_id)
),
y AS (
  SELECT *, system_names || partition_names || service_names || scope_family_names <> '' AS scope, software_names || module_names || toolchain_names <> '' AS targets,
    software_versions || toolchain_versions <> '' OR (software_names || module_names || toolchain_names <> '' AND (len(observed) > 0 OR regexp_matches(text, '(?i)\\b(versions?|releases?|latest|newest|older|oldest|upgrade|downgrade|updated?|compatible|compatibility)\\b'))) AS sensitive FROM x
)
SELECT query_id, CASE WHEN sensitive AND targets THEN 'software_version' WHEN scope OR regexp_matches(text, '(?i)\\b(slurm|sbatch|srun|salloc|ondemand|ssh|login|quota|mybalance|allocation|account|mfa|job|queue|partition)\\b') THEN 'local_operational' WHEN targets THEN 'general_how_to' END AS query_type,
  {', '.join(c for c in C.COLUMNS if c.endswith(('names', 'versions')))}, CASE WHEN scope THEN true END AS scope_required, CASE WHEN sensitive THEN true END AS version_sensitive_guess FROM y""",
}
