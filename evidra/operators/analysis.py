"""Rows of evaluation runs: annotations joined, prepared rows beside their scores, means over subgroups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.positions import joined_by_place

#: The labels that subgroups are made of.
LABELS = ("source_needed", "docs_scope_needed", "validity_sensitive", "attachment_dependent", "query_type", "version_sensitive", "system_scope_required")
ALL = ("__all__", "all")


def number(value: Column) -> Column:
    """A metric's cell as a number; what is none, and NaN, is null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def annotated(examples: DataFrame, annotations: DataFrame, key: str = "id", name: str = "benchmark_annotation") -> DataFrame:
    """``examples`` with their annotation as a struct. Reading a row without one raises an error that names its key."""
    rest = [c for c in annotations.columns if c != key]
    held = annotations.select(key, F.struct(*rest).alias("__a"))
    missing = F.raise_error(F.concat(F.lit(f"no annotation for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    joined = examples.join(held, key, "left")
    return joined.select(*examples.columns, F.when(F.col("__a").isNull(), missing.cast(held.schema["__a"].dataType)).otherwise(F.col("__a")).alias(name))


def analysis_rows(prepared: DataFrame, scores: DataFrame, condition: Mapping[str, str]) -> DataFrame:
    """Prepared rows beside their scores, both numbered by ``place``; a different number of rows raises ``ValueError``.

    Scores' columns that the prepared rows have too stay theirs; the others are metrics, as numbers. ``condition`` adds
    constant columns.
    """
    taken = {c.lower() for c in prepared.columns}
    metrics = [c for c in scores.columns if c.lower() not in taken]
    both = joined_by_place(prepared, scores.select("place", *[number(F.col(c)).alias(c) for c in metrics if c != "place"]))
    return both.withColumns({k: F.lit(v) for k, v in condition.items()})


def subgroup_means(rows: DataFrame, condition: str, labels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(condition, label_name, label_value, rows, a mean for each metric): all rows of a condition, and each value of each label.

    Blank labels are in no subgroup; means are over numbers only, null without any. Rows are unfolded in the tasks and
    added up there before they move.
    """
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^\s+|\s+$", "")
    one = lambda name, value: F.struct(F.lit(name).alias("label_name"), value.alias("label_value"))
    groups = F.filter(F.array(one(ALL[0], F.lit(ALL[1])), *[one(c, text(c)) for c in labels]), lambda g: g["label_value"] != "")
    each = rows.select(condition, *[number(F.col(m)).alias(m) for m in metrics], F.explode(groups).alias("__g"))
    return each.groupBy(condition, F.col("__g.label_name"), F.col("__g.label_value")).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(m).alias(m) for m in metrics])
