"""Sections, windows, turn packing, bootstrap and streams over the driver's tables, with SQL where it can state them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as X
from evidra.operators import aliases as A
from evidra.operators import bootstrap as B
from evidra.operators import matches as M
from evidra.operators.turns import Budget, pack_turns
from evidra.sources.shared import shared_folder
from evidra.streaming import streams as S


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.md_sections(_t(spark, sf_dir, "documents"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_windows(_t(spark, sf_dir, "documents"), 200, 40)


def chunk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_turns(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", Budget(size=120, overlap=20))


def alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ``nation`` and four license words in all documents."""
    words = spark.createDataFrame([(w,) for w in ("license", "version", "apache", "mit")], "alias string")
    return A.alias_scan(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "nation").select(F.col("n_name").alias("alias")).unionByName(words))


def module_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts beside the suppliers whose number names their brand."""
    parts = _t(spark, sf_dir, "part").select(F.lower("p_brand").alias("key"), "p_partkey")
    named = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("brand#"), (F.col("s_suppkey") % 55).cast("string")).alias("key"), "s_suppkey")
    return M.pairs_by_key(parts, named)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("condition"), F.col("c_nationkey").alias("item")).agg(F.avg("c_acctbal").alias("value"))


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bootstrap_ci(_scores(spark, sf_dir))


def bootstrap_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bootstrap_ci(B.paired(_scores(spark, sf_dir)))


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_updates(S.event_windows(S.events_stream(spark, sf_dir)), ["window_start", "event_type"], shared_folder(spark, "event-windows"))


QUERIES = {f.__name__: f for f in (md_sections, chunk_windows, chunk_turns, alias_scan, module_match, bootstrap_means, bootstrap_differences, stream_event_windows)}
_NAME = "printf('%s::chunk::%04d', doc_id::VARCHAR, {})"
SQL = {
    "chunk_windows": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents), "
    "n AS (SELECT doc_id, words, ceil(len(words) / 160.0)::INT AS n FROM w WHERE len(words) > 0), r AS (SELECT doc_id, words, n, unnest(range(n))::INT AS chunk_index FROM n) "
    f"SELECT doc_id, chunk_index, {_NAME.format('chunk_index')} AS chunk_id, CASE WHEN chunk_index > 0 THEN {_NAME.format('chunk_index - 1')} END AS prev_id, CASE WHEN chunk_index + 1 < n THEN {_NAME.format('chunk_index + 1')} END AS next_id, "
    "array_to_string(words[chunk_index * 160 + 1 : chunk_index * 160 + 200], ' ') AS chunk_text, len(words[chunk_index * 160 + 1 : chunk_index * 160 + 200])::BIGINT AS token_count, CASE WHEN chunk_index > 0 THEN 40 ELSE 0 END::BIGINT AS overlap_tokens FROM r",
    "stream_event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY date_trunc('day', ts), event_type",
}
