"""Structured Streaming: feedback summary, idempotent ingest into several stores, and windows over events."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evidra.sources.files import parsed_feedback
from evidra.sources.store import Versions, upsert

FEEDBACK = "scenario_id string, helpful string, grounded string, failure_type string"


def feedback_counts(rows: DataFrame) -> DataFrame:
    """Batch or stream: rows, helpful and grounded ones by scenario and failure type."""
    named = rows.select(F.coalesce(F.nullif("scenario_id", F.lit("")), F.lit("ad_hoc")).alias("scenario_id"), F.coalesce(F.nullif("failure_type", F.lit("")), F.lit("none")).alias("failure_type"), "helpful", "grounded")
    return named.groupBy("scenario_id", "failure_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("helpful") == "yes").alias("helpful_yes"), F.count_if(F.col("grounded") == "yes").alias("grounded_yes"))


def feedback_stream(spark: SparkSession, folder: str) -> DataFrame:
    return feedback_counts(parsed_feedback(spark.readStream.text(folder), FEEDBACK))


def event_windows(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Batch or stream: events and sum of values by type and tumbling window."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("sum_value"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", "sum_value")


def run_to_end(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is; the last state of a ``complete`` one, from Parquet."""
    spark = stream.sparkSession
    out = Versions(spark, f"{folder}/out")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: out.write(df, i)).start()
    q.awaitTermination()
    got = out.read()
    return spark.createDataFrame([], stream.schema) if got is None else got


def run_updates(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs an aggregation over all there is in ``update`` mode: the newest row of each key.

    Each batch writes the groups that it changed, under its number, so a batch that runs again replaces its own; groups
    that the watermark has passed leave the state, and rows that come later still are dropped.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/__batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(schema).parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__row")).select(*keys, *[F.col(f"__row.`{c}`") for c in rest])


def ingest(stream: DataFrame, stores: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]], key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Each batch, read once, into every store: name to (folder, how its rows are made). A batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            for root, make in stores.values():
                at = Versions(spark, root)
                held, rows = at.current(), make(batch)
                if held is None or held[0] < number:
                    old = at.read()
                    at.write(upsert(rows.limit(0) if old is None else old, rows, key, version), number)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: one file, or a folder of them. The pattern lets the source take a single file."""
    at = os.path.join(sf_dir, "events.parquet")
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(os.path.join(sf_dir, "events.parque[t]"))
