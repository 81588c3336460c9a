"""Text rules, values and the validity reranker applied to whole tables, each with SQL of its own.

The driver's texts hold few commands, so the queries over texts also read ``TEXTS``, which both engines get.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import rules as X
from evidra.functions import tickets as T
from evidra.functions import values as V
from evidra.functions.filters import matches
from evidra.operators import anonymise as A
from evidra.operators import blind as B
from evidra.operators import reranking as K

TEXTS = [
    (-1, "#SBATCH --partition=icelake-himem\n  #SBATCH -p cclake\nsbatch -p ampere job.sh && srun --partition sapphire x\nsalloc -p queue"),
    (-2, "Use the sapphire-long partition, or Icelake-Long.\r\nThe end-of-life of Cascade  Lake is near.   \n\n\n\nDone"),
    (-3, "module load gcc/11.2.0 openmpi-4.1 # not this\n$ module load -q 'python/3.9' && module load cuda/12.1; echo"),
    (-4, "This service is legacy, was retired, and maintenance goes on."),
    (-5, "MATLAB R2023a and GCC 11.3.0-rc1 are recommended; 1.2.3.4 too, and 10.1 not twice 10.1"),
    (-6, "Log in to login-icelake or the A100 nodes of dawn; see /rds/user/ab123/run/file.txt"),
    (-7, "mail a.b@example.org from 10.1.2.3, eolian harps are unsupported"),
    (-8, ""),
]
STAMPS = [("2024-02-29T10:00:00.123+0100", 1709197200.123), ("2024-02-29T10:00:00Z", 1709200800.0), ("2024-02-29 10:00:00", 1709200800.0), ("2024-02-29", 1709164800.0), (" 2024-02-29 ", 1709164800.0), ("2024-02-30", None), ("20240229", 1709164800.0), ("2024-02-29T10", 1709200800.0), ("20240229T1000", 1709200800.0), ("20240229T100000.1234567+0100", 1709197200.123456), ("2024-02-29 10:00:00.1234567", 1709200800.123456), ("2024-02-29T10+01:00", 1709197200.0), ("2024-02", None), ("yesterday", None), ("", None)]
NUMBERS = [("1.5", 1.5), (" 2 ", 2.0), ("true", 1.0), ("False", 0.0), ("1e3", 1000.0), (".5", 0.5), ("", None), ("abc", None), ("0x1", None), ("12d", None)]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def _sql_list(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''").replace("\r", "'||chr(13)||'").replace("\n", "'||chr(10)||'") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", X.status(F.col("text")).alias("status"))


def partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(X.partitions(F.col("text"))).alias("partition_name"))


def module_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(X.modules(F.col("text"))).alias("module"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(X.versions(F.col("text"))).alias("version"))


def scope_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(X.families(F.col("text"))).alias("family"))


def privacy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.array_join(X.privacy_flags(F.col("text")), "|").alias("flags"))


def normalise_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks and tabs before line ends go; other white space stays."""
    x = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "[ \t]+\n", "\n")
    return _texts(spark, sf_dir).select("doc_id", F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+\z", "").alias("text"))


def normalise_md_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", X.markdown_plain(F.col("text")).alias("text"))


def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.inline(X.personal(F.col("text"))))


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", X.masked(F.coalesce("text", F.lit("")), X.personal(F.col("text"))).alias("text"))


def anonymised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers: users' turns are tickets, assistants' are documents."""
    c = _t(spark, sf_dir, "conversations")
    key = F.concat(F.lit("HPC-"), F.col("conv_id"))
    context = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws("-", key, "turn").alias("doc_id"), F.concat(key, F.lit(": "), "text").alias("text"), F.when(F.col("role") == "user", "tickets").otherwise("docs").alias("source"))
    answers = c.select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), F.concat(F.lit("See "), key, F.lit(" and (mail of a.b@example.org)")).alias("answer"))
    told, shown, _ = A.anonymised(answers, context)
    return shown.select("query_id", "rank", "doc_id", "text").join(told, "query_id")


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", V.slug(F.col("url")).alias("slug"))


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", V.error_class(F.col("url")).alias("error_class"))


def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _t(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0100")).alias("stamp"))
    given = spark.createDataFrame([(s,) for s, _ in STAMPS], "stamp string")
    return made.unionByName(given).select("stamp", V.parse_timestamp(F.col("stamp")).alias("seconds"))


def time_to_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    end = F.when(F.col("o_orderstatus") != "O", F.concat(F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd"), F.lit("T12:00:00+0200")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", V.seconds_between(start, end).alias("seconds"))


def freshness_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    held = F.create_map(F.lit("modified_at"), day, F.lit("created_at"), F.when(F.col("o_orderstatus") == "O", F.lit(" ")).otherwise(F.col("o_orderpriority")), F.lit("other"), F.lit("x"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", V.first_date(held).alias("hint"))


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(s,) for s, _ in NUMBERS], "raw string")
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("raw")).unionByName(_t(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("raw"))).unionByName(given)
    return rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", "n", V.numeric(F.col("raw")).alias("number"))


def entity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select("n_nationkey", V.entity_id(F.lit("local"), F.lit("nation"), F.col("n_name")).alias("entity_id"))


def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with a nested key under ``a``; overridden whole, in part, or beside."""
    base = F.create_map(F.lit("a.b"), F.col("p_brand"), F.lit("a.c"), F.col("p_type"), F.lit("d"), F.lit("1"))
    size = F.col("p_size").cast("string")
    over = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("a"), size)).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("a.b"), size)).otherwise(F.create_map(F.lit("d.e"), size))
    entries = F.array_sort(F.transform(F.map_entries(V.merged(base, over)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ";").alias("settings"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n{\"k\": "), F.col("event_id"), F.lit("}\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: {\"k\": "), F.col("event_id"), F.lit("} there."))).otherwise(F.lit("none {here"))
    return _t(spark, sf_dir, "events").select("event_id", V.json_object(noisy).alias("json"))


def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda k, o, v: {"key": k, "op": o, "value": v}
    tree = {"or": [{"and": [leaf("lang", "==", "en"), leaf("n_chars", ">=", 300)]}, {"and": [leaf("lang", "in", ["de", "fr"]), {"not": [leaf("source", "==", "src1"), leaf("source", "==", "src2")]}]}]}
    return _t(spark, sf_dir, "documents").where(matches(tree)).select("doc_id")


def filter_leaf_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").withColumn("tags", F.when(F.col("n_chars") % 7 != 0, F.array("lang", "source")))
    leaves = {"eq": ("lang", "==", "en"), "ne": ("lang", "!=", "en"), "gt": ("n_chars", ">", 500), "ge": ("n_chars", ">=", 500), "lt": ("n_chars", "<", 500), "le": ("n_chars", "<=", 500), "within": ("lang", "in", ["de", "es"]), "nin": ("lang", "nin", ["de", "es"]), "any": ("tags", "any", ["en", "src3"]), "all": ("tags", "all", ["en", "src3"]), "unknown": ("lang", "~", "en")}
    counts = rows.agg(*[F.count_if(matches(dict(zip(("key", "op", "value"), x)))).alias(k) for k, x in leaves.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in leaves])))


def message_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments: even conversations were created by their reporter."""
    c, odd = F.col("conv_id"), F.col("conv_id") % 2 == 1
    email = F.when(F.col("role") == "assistant", F.lit("desk@x.org")).when(F.col("turn") % 5 == 0, F.lit("lead@x.org")).otherwise(F.concat(F.lit("user"), c, F.lit("@x.org")))
    name = F.when(F.col("role") == "system", T.AUTOMATION)
    user = F.concat(F.lit("user"), c, F.lit("@x.org"))
    role = T.comment_role(name, email, F.lit("desk@x.org"), F.when(odd, F.lit("other@x.org")).otherwise(user), F.when(c % 3 == 0, F.lit("lead@x.org")), user)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("message_role"))


def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a tree of a heading, a paragraph, a list and a quote."""
    leaf = lambda c: F.concat(F.lit('{"type":"text",'), F.substring(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("text"))), 2, 1 << 30))
    node = lambda kind, *inner: F.concat(F.lit(f'{{"type":"{kind}","content":['), *[x for i in inner for x in (F.lit(","), i)][1:], F.lit("]}"))
    item = lambda c: node("listItem", node("paragraph", leaf(c)))
    role, text = F.col("role"), F.col("text")
    tree = node("doc", node("heading", leaf(role)), node("paragraph", leaf(text)), node("bulletList", item(F.lit("one")), item(F.lit("two"))), node("blockquote", node("paragraph", leaf(role))))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.rich_text(tree).alias("text"))


def blind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conditions' answers to every benchmark item under labels."""
    names = ["dense", "bm25", "hybrid"]
    item = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*map(F.lit, names))).alias("condition"))
    return B.blind_sheet(item.withColumn("response", F.concat("condition", F.lit(" on "), "query_id")), names, 7)


WEIGHTS = {"authority": 0.3, "scope": 0.2, "software": 0.25, "scope_family": 0.15, "version": 0.1, "status": 0.12, "freshness": 0.05}
AUTHORITY = {"local_official": 1.0, "external_official": 0.6, "ticket_memory": 0.2}
STATUS = {"current": 1.0, "maintenance": 0.5, "legacy": -0.5, "eol": -1.0}


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as candidates, twenty a query, of two sources, and what is asked; every second query asks for a brand."""
    one = lambda when, x: F.when(when, F.array(x)).otherwise(F.array().cast("array<string>"))
    size, q = F.col("p_size"), F.col("query_id")
    none = F.array().cast("array<string>")
    source = F.when(size % 4 == 0, "Local_Official ").when(size % 4 == 1, "external_official").when(size % 4 == 2, "forum")
    ranks = F.when(size % 3 == 0, F.create_map(F.lit("docs"), F.col("p_partkey") % 20 + 1, F.lit("tickets"), size.cast("long"))).otherwise(F.create_map(F.lit("docs"), F.col("p_partkey") % 20 + 1))
    day = F.when(size % 5 != 0, F.concat(F.lit("2020-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0")))
    part = _t(spark, sf_dir, "part")
    rows = part.select(
        F.floor(F.col("p_partkey") / 20).alias("query_id"), F.col("p_partkey").cast("string").alias("id"), ranks.alias("source_ranks"), F.col("p_retailprice").alias("best_score"),
        source.alias("source_authority"), F.when(size % 4 == 0, "current").when(size % 4 == 1, "LEGACY").when(size % 4 == 2, "").alias("validity_status"), day.alias("freshness_hint"),
        F.array("p_brand").alias("software_names"), F.array("p_type").alias("system_names"), one(size % 6 == 0, F.lit("icelake-himem")).alias("partition_names"), none.alias("service_names"),
        one(size % 2 == 0, F.lit("icelake")).alias("scope_family_names"), none.alias("module_names"), F.array(size.cast("string")).alias("software_versions"), none.alias("toolchain_versions"),
    )
    asked = rows.select("query_id").distinct().select(
        "query_id", F.when(q % 2 == 0, F.array(F.concat(F.lit("BRAND#"), q % 5 + 1, q % 5 + 1), F.lit("Brand#13"))).alias("software_names"), one(q % 3 == 0, F.lit(" economy ")).alias("system_names"), none.alias("partition_names"), none.alias("service_names"),
        one(q % 4 < 3, F.lit("icelake")).alias("scope_family_names"), none.alias("module_names"), F.when(q % 5 == 0, F.array(F.lit("10"), F.lit("20"), F.lit("30"))).otherwise(none).alias("software_versions"), none.alias("toolchain_versions"),
    )
    return rows, asked


def validity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.validity_rerank(*candidates(spark, sf_dir), WEIGHTS, AUTHORITY, STATUS, {"tickets": 0.5})
    return out.select("query_id", "id", "gate", F.round("final", 6).alias("final"), "place")


QUERIES = {f.__name__: f for f in (anonymised_answers, lifecycle_status, partition_names, module_tokens, versions, scope_families, privacy_flags, normalise_md, normalise_md_b, pii_detect, pii_mask, slugify, error_classes, parse_ts, time_to_resolution, freshness_hint, numeric_coerce, entity_id, map_merge, json_extract, filter_tree, filter_leaf_ops, message_role, rich_text, blind_pivot, validity_rerank)}
_D = f"d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_sql_list(TEXTS, 'doc_id, text')})"
_STRIP = "regexp_replace(regexp_replace(x, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '{0}', '', 'g')"
_FAMILY = {
    "cclake": "cclake|cascade\\s+lake|login-cascadelake", "icelake": "icelake|ice\\s+lake|default-icl|login-icelake", "sapphire": "sapphire|sapphire\\s+rapids?",
    "ampere": "ampere|a100|default-amp|wilkes3", "pvc": "pvc|dawn", "wbic": "wbic",
}
SQL = {
    # the made texts hold no other values than the keys: of a conversation's tickets' ids the first ones, then the key that all their texts name
    "anonymised_answers": "WITH c AS (SELECT conv_id, turn, role = 'user' AS ticket, 'HPC-' || conv_id AS key, text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS n, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), "
    "k AS (SELECT *, 'TICKET_' || lpad((n + 1)::VARCHAR, 3, '0') AS alias FROM c) SELECT conv_id AS query_id, turn AS rank, CASE WHEN ticket THEN 'TICKET_' || lpad(i::VARCHAR, 3, '0') ELSE key || '-' || turn END AS doc_id, "
    "CASE WHEN ticket THEN alias ELSE key END || ': ' || text AS text, 'See ' || CASE WHEN n > 0 THEN alias ELSE key END || ' and (mail of a.b@example.org)' AS answer FROM k",
    "lifecycle_status": f"WITH {_D} SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(eol|end[- ]of[- ]life)\\b') THEN 'eol' WHEN regexp_matches(text, '(?i)\\b(legacy|retired|deprecated)\\b') THEN 'legacy' WHEN regexp_matches(text, '(?i)\\bmaintenance\\b') THEN 'maintenance' WHEN regexp_matches(text, '(?i)\\b(current|recommended|supported)\\b') THEN 'current' ELSE 'unknown' END AS status FROM d",
    "partition_names": f"WITH {_D}, p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?im)^[ \\t]*#SBATCH\\s+(?:--partition(?:=|\\s+)|-p\\s+)([A-Za-z0-9][A-Za-z0-9_-]*)', 1)) AS n FROM d UNION SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:sbatch|srun|salloc)\\b[^\\n#]*(?:--partition(?:=|\\s+)|-p\\s+)([A-Za-z0-9][A-Za-z0-9_-]*)', 1)) FROM d UNION SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b([A-Za-z0-9][A-Za-z0-9_-]*-long)\\b', 1)) FROM d) SELECT DISTINCT doc_id, n AS partition_name FROM p WHERE lower(n) NOT IN ('partition', 'partitions', 'queue')",
    "module_tokens": f"WITH {_D}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?im)(?:^|&&|;)\\s*(?:[$]+\\s*)?module\\s+load\\s+((?:[^\\n#;&]|&[^\\n#;&])+)', 1)) AS c FROM d), w AS (SELECT doc_id, unnest(regexp_split_to_array(split_part(c, '&&', 1), '[\\s,]+')) AS t FROM m) SELECT DISTINCT doc_id, trim(t, '`''\"()[]{{}}') AS module FROM w WHERE trim(t, '`''\"()[]{{}}') <> '' AND t NOT LIKE '-%'",
    "versions": f"WITH {_D}, v AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:[0-9]+[.][0-9]+(?:[.][0-9]+)?(?:[.][0-9]+)?(?:[-+_][A-Za-z0-9][A-Za-z0-9.+_-]*)?|r[0-9][0-9][0-9][0-9][a-z])\\b')) AS version FROM d) SELECT doc_id, version FROM v",
    "scope_families": f"WITH {_D}, f AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in _FAMILY.items())}) x(family, names)) SELECT doc_id, family FROM d, f WHERE regexp_matches(text, '(?i)\\b(' || names || ')\\b')",
    "privacy_flags": f"WITH {_D} SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z][A-Z]+\\b') THEN 'email' END, CASE WHEN regexp_matches(text, '\\b(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}\\b') THEN 'ip' END, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])/([A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+') THEN 'path' END) AS flags FROM d",
    "normalise_md": f"WITH {_D}, n AS (SELECT doc_id, regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \\t]+' || chr(10), chr(10), 'g') AS x FROM d) SELECT doc_id, {_STRIP.format('^[ \\t\\n]+|[ \\t\\n]+$')} AS text FROM n",
    "normalise_md_b": f"WITH {_D}, n AS (SELECT doc_id, array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: regexp_replace(l, '[ \\t\\x0B\\f]+$', '')), chr(10)) AS x FROM d) SELECT doc_id, {_STRIP.format('^[ \\t\\n\\x0B\\f]+|[ \\t\\n\\x0B\\f]+$')} AS text FROM n",
    "slugify": "SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM pages",
    "error_classes": "SELECT page_id, coalesce(nullif(trim(split_part(url, ':', 1)), ''), 'UnknownError') AS error_class FROM pages",
    "parse_ts": f"SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g+0100') AS stamp, epoch_us(o_orderdate) / 1e6 - 3600 AS seconds FROM orders UNION ALL SELECT stamp, seconds FROM {_sql_list(STAMPS, 'stamp, seconds')}",
    "time_to_resolution": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN epoch(date_trunc('day', o_orderdate) + INTERVAL 3 DAY + INTERVAL 10 HOUR) - epoch(date_trunc('second', o_orderdate)) END AS seconds FROM orders",
    "freshness_hint": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS hint FROM orders",
    "numeric_coerce": f"WITH r AS (SELECT p_brand AS raw, NULL AS number FROM part UNION ALL SELECT p_size::VARCHAR, p_size::DOUBLE FROM part UNION ALL SELECT raw, number FROM {_sql_list(NUMBERS, 'raw, number')}) SELECT raw, count(*) AS n, max(number) AS number FROM r GROUP BY raw",
    "entity_id": "SELECT n_nationkey, substr(sha1('local|nation|' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g'))), 1, 16) AS entity_id FROM nation",
    "map_merge": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a=' || p_size || ';d=1' WHEN 1 THEN 'a.b=' || p_size || ';a.c=' || p_type || ';d=1' ELSE 'a.b=' || p_brand || ';a.c=' || p_type || ';d.e=' || p_size END AS settings FROM part",
    "json_extract": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{}' ELSE '{\"k\": ' || event_id || '}' END AS json FROM events",
    "filter_tree": "SELECT doc_id FROM documents WHERE (lang = 'en' AND n_chars >= 300) OR (lang IN ('de', 'fr') AND source NOT IN ('src1', 'src2'))",
    "filter_leaf_ops": "WITH n AS (UNPIVOT (SELECT count_if(lang = 'en') AS eq, count_if(lang IS DISTINCT FROM 'en') AS ne, count_if(n_chars > 500) AS gt, count_if(n_chars >= 500) AS ge, count_if(n_chars < 500) AS lt, count_if(n_chars <= 500) AS le, count_if(lang IN ('de', 'es')) AS within, count_if(lang IS NULL OR lang NOT IN ('de', 'es')) AS nin, count_if(n_chars % 7 <> 0 AND (lang = 'en' OR source = 'src3')) AS any_, count_if(n_chars % 7 <> 0 AND lang = 'en' AND source = 'src3') AS all_, count_if(lang = 'en') AS unknown FROM documents) ON COLUMNS(*) INTO NAME op VALUE n) SELECT rtrim(op, '_') AS op, n::BIGINT AS n FROM n",
    "message_role": "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'AUTOMATED_PSEUDOUSER' WHEN role = 'assistant' THEN 'HELPDESK_ASSIGNEE' WHEN turn % 5 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'HELPDESK_PRINCIPAL_INVESTIGATOR' ELSE 'OTHER' END WHEN conv_id % 2 = 0 THEN 'TICKET_CREATOR' ELSE 'REPORTER' END AS message_role FROM conversations",
    "rich_text": "SELECT conv_id, turn, '# ' || trim(role) || chr(10) || coalesce(text, '') || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '> ' || role || chr(10) AS text FROM conversations",
    "blind_pivot": "WITH a AS (SELECT item_id AS query_id, c, row_number() OVER (PARTITION BY item_id ORDER BY md5('7|' || item_id || '|' || c)) AS n FROM benchmark, (VALUES ('dense'), ('bm25'), ('hybrid')) v(c)) SELECT query_id, max(CASE WHEN n = 1 THEN c END) || ' on ' || query_id AS \"system_A\", max(CASE WHEN n = 2 THEN c END) || ' on ' || query_id AS \"system_B\", max(CASE WHEN n = 3 THEN c END) || ' on ' || query_id AS \"system_C\" FROM a GROUP BY query_id",
    "validity_rerank": """WITH c AS (SELECT p_partkey // 20 AS query_id, p_partkey::VARCHAR AS id, p_retailprice AS best, p_size AS s, lower(p_brand) AS brand, lower(p_type) AS kind,
  1.0::DOUBLE / (60 + p_partkey % 20 + 1) + CASE WHEN p_size % 3 = 0 THEN 0.5::DOUBLE / (60 + p_size) ELSE 0 END AS rrf FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, id DESC) AS base_rank, min(rrf) OVER (PARTITION BY query_id) AS lo, max(rrf) OVER (PARTITION BY query_id) AS hi,
  CASE s % 4 WHEN 0 THEN 'local_official' WHEN 1 THEN 'external_official' WHEN 2 THEN 'forum' ELSE 'unknown' END AS auth FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, auth, s % 5 = 0 ORDER BY s % 28 DESC, id DESC) AS i, count(*) OVER (PARTITION BY query_id, auth, s % 5 = 0) AS n FROM r),
g AS (SELECT *, CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (rrf - lo) / (hi - lo) END::DOUBLE AS base, CASE s % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0 END::DOUBLE AS a,
  CASE WHEN query_id % 3 <> 0 THEN 0 WHEN kind = 'economy' THEN 1 ELSE -1 END AS sc, CASE WHEN query_id % 2 <> 0 THEN 0 WHEN brand IN ('brand#13', 'brand#' || (query_id % 5 + 1) || (query_id % 5 + 1)) THEN 1 ELSE -1 END AS sw,
  CASE WHEN query_id % 4 < 3 AND s % 2 = 0 THEN 1 ELSE 0 END AS fam, CASE WHEN query_id % 5 <> 0 THEN 0 WHEN s IN (10, 20, 30) THEN 1 ELSE -1 END AS v, CASE s % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -0.5 ELSE 0 END::DOUBLE AS st,
  CASE WHEN s % 5 = 0 THEN 0 WHEN n = 1 THEN 1 ELSE 1 - (i - 1) / (n - 1)::DOUBLE END AS fr FROM f),
h AS (SELECT *, CASE WHEN fam <= 0 OR query_id % 2 <> 0 THEN 'applied' WHEN sw <= 0 THEN 'blocked_no_software_match' WHEN query_id % 3 <> 0 AND s % 6 = 0 THEN 'blocked_specialized_variant' ELSE 'applied' END AS gate FROM g),
t AS (SELECT *, base + 0.3::DOUBLE * a + 0.2::DOUBLE * sc + 0.25::DOUBLE * sw + 0.15::DOUBLE * CASE WHEN gate = 'applied' THEN fam ELSE 0 END + 0.1::DOUBLE * v + 0.12::DOUBLE * st + 0.05::DOUBLE * fr AS total FROM h)
SELECT query_id, id, gate, round(total, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, base DESC, base_rank, id) AS place FROM t""",
}
