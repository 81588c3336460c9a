"""Stores, logs, run folders and fused candidate lists: the library's functions over the driver's tables, with SQL of their own."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import reranking as K
from evidra.sources import files as X
from evidra.sources import store as S


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events up to a day as a store by user, and those since as what is put into it."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    old = S.upsert(e.limit(0), e.where("event_type <> 'error'"), "user_id", "event_id")
    return S.upsert(old, e.where("event_type = 'error'"), "user_id", "event_id")


def delete_ref_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of conversations: toxic conversations go whole, of bad ones the first turn."""
    turns = _t(spark, sf_dir, "conversations").select(F.concat_ws("::", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("parent_id"))
    labels = _t(spark, sf_dir, "labels")
    ids = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")).unionByName(labels.where("quality = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit("::0")).alias("id")))
    return S.delete(turns, ids)


def runs_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of runs, one folder for each customer's order of a year; urgent runs lack a file, and some folders are no runs."""
    o = _t(spark, sf_dir, "orders")
    run = F.when(F.col("o_orderstatus") == "P", F.lit("notes")).otherwise(F.concat(F.lit("run_"), F.when(F.col("o_orderstatus") == "F", F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")).otherwise("last")))
    folder = F.concat(F.lit("/stage/c"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"), F.lit("/"), run)
    names = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(*map(F.lit, X.RUN_FILES[:2]))).otherwise(F.array(*map(F.lit, [*X.RUN_FILES, "log.txt"])))
    return X.complete_runs(o.select(folder.alias("folder"), F.explode(names).alias("file")).select(F.concat_ws("/", "folder", "file").alias("path")))


def events_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as a log of lines, every kind of event but errors written well."""
    line = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_type") == "view", F.concat(F.lit("  "), "props")).otherwise(F.col("props"))
    lines = _t(spark, sf_dir, "events").select(line.alias("value")).unionByName(spark.createDataFrame([("",), ("no json",), ("[1]",)], "value string"))
    return X.parsed_feedback(lines, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hits: an order asks, a part is found, by return flags as sources."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"))


def multi_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.merged(_hits(spark, sf_dir))
    ranks = F.array_join(F.array_sort(F.transform(F.map_entries("source_ranks"), lambda e: F.concat_ws(":", e["key"], e["value"]))), "|")
    return out.select("query_id", "id", ranks.alias("ranks"), "best_score", F.when(F.size("sources") > 1, "multi").otherwise(F.col("sources")[0]).alias("source"))


def rrf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged candidates, the returned ones weighted twice."""
    out = K.rrf_rerank(K.merged(_hits(spark, sf_dir)), {"R": 2.0})
    return out.select("query_id", "id", F.round("rrf", 9).alias("rrf"), "place")


QUERIES = {f.__name__: f for f in (upsert_latest, delete_ref_docs, runs_from_paths, events_props_json, multi_merge, rrf_rerank)}
_HITS = "h AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_returnflag AS source, min(l_linenumber) AS rank, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3)"
SQL = {
    "upsert_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "delete_ref_docs": "SELECT conv_id || '::' || turn AS id, conv_id::VARCHAR AS parent_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id AND (l.toxic = 1 OR (l.quality = 0 AND c.turn = 0)))",
    "runs_from_paths": "SELECT '/stage/c' || o_custkey || '_' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '/run_' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') ELSE '/run_last' END AS folder, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 100)::INT ELSE 0 END AS repeat_index FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'",
    "events_props_json": "SELECT (props::JSON->>'$.k')::BIGINT AS k, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
    "multi_merge": f"WITH {_HITS} SELECT query_id, id, string_agg(source || ':' || rank, '|' ORDER BY source) AS ranks, max(score) AS best_score, CASE WHEN count(*) > 1 THEN 'multi' ELSE min(source) END AS source FROM h GROUP BY 1, 2",
    "rrf_rerank": f"WITH {_HITS}, r AS (SELECT query_id, id, sum(CASE WHEN source = 'R' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank) ORDER BY source) AS rrf, max(score) AS best FROM h GROUP BY 1, 2) SELECT query_id, id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, id) AS place FROM r",
}
