"""Blind sheets: every condition's answer to a query under a label whose order differs by query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blind_key(answers: DataFrame, conditions: list[str], seed: int = 0) -> DataFrame:
    """(query_id, condition, response) with ``label``: system_A, system_B and so on, dealt by a hash of seed, query and condition.

    A query that lacks a condition, or has one twice, is an error, raised as the rows are read.
    """
    by = W.partitionBy("query_id")
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string"), "condition").cast("binary"))
    rows = answers.where(F.col("condition").isin(conditions)).withColumn("place", F.row_number().over(by.orderBy(drawn, "condition"))).withColumn("held", F.count(F.lit(1)).over(by)).withColumn("kinds", F.size(F.collect_set("condition").over(by)))
    wrong = F.raise_error(F.concat(F.lit("not every condition answers query "), F.col("query_id").cast("string"))).cast("string")
    label = F.when((F.col("held") != len(conditions)) | (F.col("kinds") != len(conditions)), wrong).otherwise(F.concat(F.lit("system_"), F.char(F.lit(64) + F.col("place"))))
    return rows.select("query_id", "condition", "response", label.alias("label"))


def blind_sheet(answers: DataFrame, conditions: list[str], seed: int = 0) -> DataFrame:
    """A row a query, a column a label."""
    labels = [f"system_{chr(65 + i)}" for i in range(len(conditions))]
    return blind_key(answers, conditions, seed).groupBy("query_id").pivot("label", labels).agg(F.first("response"))
