"""Readers and writers of the files that evaluation and ingest exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The annotation file's columns in their order.
ANNOTATION_COLUMNS = ["id", "split", "summary", "source_needed", "docs_scope_needed", "validity_sensitive", "attachment_dependent", "query_type", "version_sensitive", "system_scope_required", "review_status", "notes"]
#: The files that make a run folder complete.
RUN_FILES = ["scores.csv", "summary.json", "run_manifest.json"]
_CSV = {"header": True, "multiLine": True, "escape": '"', "maxCharsPerColumn": -1}


def _is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where("trim(value) <> ''").select(F.substring(F.trim("value"), 1, 1)).head(1)
    return bool(first) and first[0][0] == "["


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character. An array's elements that aren't objects are left out; a bad line is an error."""
    array = _is_array(spark, path)
    return spark.read.schema(schema).json(path, multiLine=array, mode="DROPMALFORMED" if array else "FAILFAST")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file (blank lines and lines after # left out), a JSON array, or JSON lines of strings or of objects with ``id``."""
    if _is_array(spark, path):
        text = spark.read.text(path, wholetext=True)
        ids = text.select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    else:
        ids = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    v = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.id")).when(F.col("v").rlike('^".*"$'), F.expr("substring(v, 2, length(v) - 2)")).otherwise(F.col("v"))
    return ids.select(F.trim(v).alias("id")).where("id <> ''").distinct()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The annotation file, each cell trimmed, null cells empty. Missing columns are an error."""
    raw = spark.read.options(**_CSV).csv(path)
    if missing := [c for c in ANNOTATION_COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ANNOTATION_COLUMNS])


def write_annotations(rows: DataFrame, path: str) -> None:
    rows.select(*ANNOTATION_COLUMNS).write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def read_unique(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """A CSV file with one row per key; a key that occurs twice is an error, raised as the rows are read."""
    raw = spark.read.options(**_CSV).csv(path).withColumn(key, F.trim(key))
    twice = F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key)))
    rest = [c for c in raw.columns if c != key]
    one = raw.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
    return one.select(F.when(F.col("__n") > 1, twice.cast("string")).otherwise(F.col(key)).alias(key), *rest)


def read_feedback(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The feedback log; blank lines and lines that are no JSON object are left out."""
    return parsed_feedback(spark.read.text(path), schema)


def parsed_feedback(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows of a log's lines (column ``value``), batch or stream."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    bad = "__bad"
    full = T.StructType([*fields.fields, T.StructField(bad, T.StringType())])
    out = lines.where(F.trim("value").startswith("{")).select(F.from_json(F.trim("value"), full, {"columnNameOfCorruptRecord": bad}).alias("r")).select("r.*")
    return out.where(F.col(bad).isNull()).drop(bad)


def complete_runs(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, repeat_index) of each ``run_*`` folder that holds all of ``RUN_FILES``; the index is its name's last digits, 0 without any."""
    parts = files.select(F.regexp_extract(path, r"^(.*/(run_[^/]*))/([^/]+)$", 1).alias("folder"), F.regexp_extract(path, r"^.*/(run_[^/]*)/([^/]+)$", 2).alias("file"))
    whole = parts.where(F.col("folder") != "").where(F.col("file").isin(RUN_FILES)).groupBy("folder").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(RUN_FILES))
    return whole.select("folder", F.coalesce(F.regexp_extract("folder", r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("repeat_index"))
