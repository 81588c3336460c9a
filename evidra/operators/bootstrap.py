"""Percentile bootstrap of condition means and of paired differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The method's number of resamples and the bounds of its interval.
RESAMPLES, LOW, HIGH = 50_000, 0.025, 0.975


def paired(scores: DataFrame, condition: str = "condition", item: str = "item", value: str = "value") -> DataFrame:
    """Differences first minus second of each two conditions, on the items that both have."""
    a = scores.select(F.col(item).alias("i"), F.col(condition).alias("a"), F.col(value).alias("x"))
    b = scores.select(F.col(item).alias("i"), F.col(condition).alias("b"), F.col(value).alias("y"))
    both = a.join(b, "i").where("a < b and x is not null and y is not null")
    return both.select(F.concat_ws(" - ", "a", "b").alias(condition), F.col("i").alias(item), (F.col("x") - F.col("y")).alias(value))


def bootstrap_ci(scores: DataFrame, condition: str = "condition", item: str = "item", value: str = "value", resamples: int = RESAMPLES, seed: int = 1) -> DataFrame:
    """condition, n, mean, ci_low, ci_high. Null values count for nothing.

    Each draw is a hash of seed, resample and place, so a task that runs again draws the same; a condition's
    draws don't depend on the others. Draws join the values by place, and averages are made before rows move on.
    """
    from pyspark.sql import Window as W

    known = scores.select(F.col(condition).alias("c"), F.col(item).alias("i"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    placed = known.select("c", "v", (F.row_number().over(W.partitionBy("c").orderBy("i", "v")) - 1).cast("long").alias("at"))
    size = known.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    draws = (
        size.select("c", "n").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .select("c", "b", F.pmod(F.xxhash64(F.lit(seed), "b", "i"), "n").alias("at"))
    )
    times = draws.groupBy("c", "at", "b").agg(F.count(F.lit(1)).alias("times"))
    means = times.join(placed, ["c", "at"]).groupBy("c", "b").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    bounds = means.groupBy("c").agg(F.percentile("m", F.array(F.lit(LOW), F.lit(HIGH))).alias("p"))
    return size.join(bounds, "c").select(F.col("c").alias(condition), "n", F.round("mean", 6).alias("mean"), F.round(F.col("p")[0], 6).alias("ci_low"), F.round(F.col("p")[1], 6).alias("ci_high"))
