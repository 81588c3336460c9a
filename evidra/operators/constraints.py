"""What a query asks for: systems, partitions, services, software, modules, versions and the kind of question.

Names come from a registry of entities. Every alias and every known version of the registry is looked for by
its first token, which joins to the tokens of the queries; the literal itself then decides, between characters
that are no letters or digits. An alias of several entities is resolved by the words around its first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import rules as X
from evidra.sources.shared import written

#: Commands and words that name modules and partitions, and words around an alias that say what it is.
MODULE_LOAD = r"(?:^|&&|;)\s*(?:\$+\s*)?module\s+load\s+([^\n#;]+)"
VERSION = r"\b(?:\d+\.\d+(?:\.\d+){0,2}(?:[-+_][A-Za-z0-9][A-Za-z0-9.+_-]*)?|r\d{4}[a-z])\b"
PARTITION_ASSIGNED = r"(?:--partition(?:=|\s+)|-p\s+)([A-Za-z0-9][A-Za-z0-9_-]*)\b"
PARTITION_NAMED = r"\b(?:partition|queue)\s*(?:=|:)?\s*([A-Za-z0-9][A-Za-z0-9_-]*)\b"
ON_PARTITION = r"\bon\s+(?:the\s+)?([A-Za-z0-9][A-Za-z0-9_-]*)\s+partition\b"
MODULE_WORDS = r"\b(?:module|modules|spack)\b"
PARTITION_WORDS = r"\b(?:partition|queue|sbatch|srun|salloc)\b|--partition|(?<!\w)-p\b"
RUN_WORDS = r"\b(?:run|running|submit|submitting|launch|launching|execute|executing|compile|compiling|build|building|install|installing|use|using|develop|development|job|jobs)\b"
SYSTEM_WORDS = r"\b(?:node|nodes|system|cluster)\b"
LOCAL_WORDS = r"\b(?:slurm|sbatch|srun|salloc|ondemand|ssh|login|quota|mybalance|allocation|account|mfa|job|queue|partition)\b"
VERSION_WORDS = r"\b(?:version|versions|release|releases|latest|newest|older|oldest|upgrade|downgrade|update(?:d)?|compatible|compatibility)\b"
#: Characters on either side of an alias that decide what it is, and whether it hints at a family.
AROUND, AROUND_FAMILY = 28, 32

NAMES = {"system": "system_names", "partition": "partition_names", "service": "service_names", "software": "software_names", "module": "module_names", "toolchain": "toolchain_names"}
VERSIONS = {"software": "software_versions", "toolchain": "toolchain_versions"}
COLUMNS = ["query_type", "system_names", "partition_names", "service_names", "scope_family_names", "software_names", "software_versions", "module_names", "toolchain_names", "toolchain_versions", "scope_required", "version_sensitive_guess"]
ANCHOR = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
_FLAGS = "(?imU)"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def has(text: Column, words: str) -> Column:
    return text.rlike(_FLAGS + words)


def all_of(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(group))


def indexable(alias: Column) -> Column:
    """Two letters or digits and three characters at least; a digit makes up for the second, a slash or hyphen for both."""
    joined = alias.contains("/") | alias.contains("-")
    two = F.char_length(F.regexp_replace(alias, r"[^\p{L}\p{N}]", "")) >= 2
    return (alias != "") & (joined | (two & ((F.char_length(alias) >= 3) | alias.rlike(r"\p{Nd}"))))


def entity_aliases(entities: DataFrame) -> DataFrame:
    """(alias, entity_id, entity_type) of the indexable names and aliases, in small letters."""
    every = F.filter(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: a.isNotNull())
    rows = entities.select("entity_id", "entity_type", F.explode(every).alias("a")).select("entity_id", "entity_type", trimmed(F.col("a")).alias("a"))
    return rows.where(indexable(F.col("a"))).select(F.lower("a").alias("alias"), "entity_id", "entity_type").distinct()


def literal_hits(queries: DataFrame, literals: DataFrame) -> DataFrame:
    """(query_id, literal, text, at) of every literal (one column, small letters) in a text, ``at`` its first place from 0.

    Case doesn't count, and no letter or digit of ASCII stands on either side.
    """
    first = lambda x: F.regexp_extract(x, ANCHOR, 0)
    lit = literals.select(F.col(literals.columns[0]).alias("literal")).distinct().withColumn("anchor", first(F.col("literal")))
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(ANCHOR), F.lit(0)))).alias("anchor"))
    quoted = F.concat(F.lit(r"\Q"), F.replace("literal", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    bounded = F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    found = tokens.join(lit, "anchor").join(queries.select("query_id", "text"), "query_id").withColumn("pattern", bounded).where(F.rlike("text", F.concat(F.lit("(?iu)"), "pattern")))
    return found.select("query_id", "literal", "text", F.expr("char_length(regexp_extract(text, concat('(?isu)^(.*?)', pattern), 1))").alias("at"))


def around(text: Column, at: Column, literal: Column, radius: int) -> Column:
    left = F.greatest(at - radius, F.lit(0))
    return F.substring(text, left + 1, at + F.char_length(literal) + radius - left)


def alias_context(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, alias, reading) of every alias in a query, and of each of these the entities that it stands for and the families it hints at.

    Columns: query_id, alias, reading, entity_ids, families. ``reading`` is ``only`` for an alias of one entity, or what
    the words around the first place make of it: partition, system, module, software, or ``open``.
    """
    named = entity_aliases(entities)
    member = F.struct("entity_type", "entity_id")
    groups = named.groupBy("alias").agg(F.collect_set(member).alias("members"))
    kinds = F.array_distinct(F.transform("members", lambda m: m["entity_type"]))
    within = lambda *allowed: F.forall(kinds, lambda k: k.isin(*allowed))
    groups = groups.withColumn("scope", within("partition", "system")).withColumn("tools", within("software", "module", "toolchain") & F.array_contains(kinds, "software"))
    hits = literal_hits(queries, named.select("alias")).withColumnRenamed("literal", "alias").join(groups, "alias")
    near, wide = (around(F.col("text"), F.col("at"), F.col("alias"), r) for r in (AROUND, AROUND_FAMILY))
    scope = F.when(has(near, PARTITION_WORDS), "partition").when(has(near, SYSTEM_WORDS), "system").otherwise("open")
    tools = F.when(has(near, MODULE_WORDS), "module").otherwise("software")
    reading = F.when(F.size("members") == 1, "only").when(F.col("scope"), scope).when(F.col("tools"), tools).otherwise("open")
    meant = lambda m: (F.col("reading") == "only") | (F.col("reading") == m["entity_type"]) | ((F.col("reading") == "module") & (m["entity_type"] == "toolchain"))
    ids = F.transform(F.filter("members", meant), lambda m: m["entity_id"])
    hint = F.col("scope") & (F.size(ids) == 0) & ~has(wide, PARTITION_WORDS) & ~has(wide, SYSTEM_WORDS) & has(wide, RUN_WORDS)
    of = F.when(F.size(ids) > 0, ids).when(hint, F.transform("members", lambda m: m["entity_id"])).otherwise(F.array().cast("array<string>"))
    out = hits.withColumn("reading", reading).select("query_id", "alias", "reading", ids.alias("entity_ids"), of.alias("of"))
    every = entity_families(entities)
    fams = out.select("query_id", "alias", F.explode("of").alias("entity_id")).join(every, "entity_id").groupBy("query_id", "alias").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"))
    return out.drop("of").join(fams, ["query_id", "alias"], "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))


def entity_families(entities: DataFrame) -> DataFrame:
    """(entity_id, families) by the entity's name and aliases."""
    return entities.select("entity_id", X.families(F.concat_ws(" ", "canonical_name", "aliases")).alias("families"))


def query_constraints(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``COLUMNS`` of every query (query_id, text), read by the registry ``entities``.

    ``entities``: entity_id, entity_type, canonical_name string, aliases and known_versions array of string. Queries
    without text get empty lists and nulls. Lists are sorted and without repeats. A text is read once, however many
    queries have it: distinct texts and the registry are written to a shared folder, what is read from them joins the
    queries by text.
    """
    none = F.array().cast("array<string>")
    asked = written(queries.select("text").where(trimmed(F.col("text")) != "").distinct().withColumn("query_id", F.monotonically_increasing_id()), "texts")
    e = written(entities.withColumn("known_versions", F.coalesce("known_versions", none)), "entities")
    lists = [*NAMES.values(), *VERSIONS.values(), "scope_family_names"]
    rows = _constraints(asked, e).drop("query_id")
    return queries.select("query_id", "text").join(rows, "text", "left").select("query_id", *[F.coalesce(c, none).alias(c) if c in lists else F.col(c) for c in COLUMNS])


def _constraints(asked: DataFrame, e: DataFrame) -> DataFrame:
    """query_id, text and ``COLUMNS`` of texts that aren't blank, each row once."""
    named = entity_aliases(e)
    fams = entity_families(e)
    versions = e.select(F.explode("known_versions").alias("v")).select(F.lower(trimmed(F.col("v"))).alias("v")).where("v <> ''").distinct()
    known = literal_hits(asked, versions).groupBy("query_id").agg(F.collect_set("literal").alias("known"))
    generic = F.transform(all_of(F.col("text"), VERSION, 0), F.lower)
    asked = asked.join(known, "query_id", "left").withColumn("observed", F.array_union(generic, F.coalesce("known", F.array().cast("array<string>"))))
    modules = F.transform(F.flatten(F.transform(all_of(F.col("text"), MODULE_LOAD, 1), lambda x: F.split(trimmed(x), r"(?U)\s+"))), lambda x: F.regexp_replace(x, "^[`'\",]+|[`'\",]+$", ""))
    modules = F.array_distinct(F.filter(modules, lambda x: ~x.isin("", "&&", "\\")))
    partitions = F.concat(*[F.transform(all_of(F.col("text"), p, 1), F.lower) for p in (PARTITION_ASSIGNED, PARTITION_NAMED, ON_PARTITION)])
    by_command = asked.select("query_id", F.explode(F.array_distinct(partitions)).alias("alias")).join(named.where("entity_type = 'partition'"), "alias").select("query_id", "entity_id")
    tokens = asked.select("query_id", F.explode(modules).alias("token"))
    by_module = tokens.select("query_id", F.lower("token").alias("alias")).join(named, "alias").select("query_id", "entity_id")
    contexts = alias_context(asked.select("query_id", "text"), e)
    by_alias = contexts.select("query_id", F.explode("entity_ids").alias("entity_id"))
    matched = by_command.unionByName(by_module).unionByName(by_alias).distinct().join(e.select("entity_id", "entity_type", "canonical_name", "known_versions"), "entity_id").join(fams, "entity_id")
    matched = matched.join(asked.select("query_id", "observed"), "query_id")
    seen = F.filter("known_versions", lambda v: F.array_contains("observed", F.lower(v)))
    listed = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(x, trimmed), lambda v: v != "")))
    of = lambda kind, x: F.when(F.col("entity_type") == kind, x)
    each = matched.groupBy("query_id").agg(
        *[listed(F.collect_set(of(k, F.col("canonical_name")))).alias(n) for k, n in NAMES.items()],
        *[listed(F.flatten(F.collect_list(of(k, seen)))).alias(n) for k, n in VERSIONS.items()],
        F.flatten(F.collect_list("families")).alias("f1"),
    )
    hints = contexts.select("query_id", F.explode("families").alias("f")).unionByName(tokens.select("query_id", F.explode(X.families(F.col("token"))).alias("f"))).groupBy("query_id").agg(F.collect_set("f").alias("f2"))
    none = F.array().cast("array<string>")
    lists = [*NAMES.values(), *VERSIONS.values()]
    rows = asked.join(each, "query_id", "left").join(hints, "query_id", "left")
    rows = rows.select("query_id", "text", "observed", *[F.coalesce(n, none).alias(n) for n in lists], listed(F.concat(F.coalesce("f1", none), F.coalesce("f2", none))).alias("scope_family_names"))
    any_of = lambda *names: F.size(F.concat(*names)) > 0
    scope = any_of("system_names", "partition_names", "service_names", "scope_family_names")
    targets = any_of("software_names", "module_names", "toolchain_names")
    sensitive = any_of("software_versions", "toolchain_versions") | (targets & (has(F.col("text"), VERSION_WORDS) | (F.size("observed") > 0)))
    kind = F.when(sensitive & targets, "software_version").when(scope | has(F.col("text"), LOCAL_WORDS), "local_operational").when(targets, "general_how_to")
    rows = rows.withColumn("query_type", kind).withColumn("scope_required", F.when(scope, True)).withColumn("version_sensitive_guess", F.when(sensitive, True))
    return rows.select("query_id", "text", *COLUMNS)
