"""What the operators share: the folder that all machines see, tables written there, and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="shared-"))
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(df: DataFrame, prefix: str, *names: str) -> list[str]:
    """Names that clash with no column of ``df``, however it is spelt."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__{prefix}_{n}"
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], of: Callable[[Iterator[list]], Iterator[list[list]]], as_bytes: bool = True) -> DataFrame:
    """Adds columns that a Python function makes of the column ``text``, batch by batch over Arrow.

    ``of`` gets an iterator of lists of values (bytes or str, None for null) and gives, for each, one
    list for each new field. Columns of ``df`` whose names clash with a new field are replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    (raw,) = own_names(df, "in", text)
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary" if as_bytes else "string").alias(raw))
    schema = T.StructType([f for f in src.schema.fields if f.name != raw] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def values() -> Iterator[list]:
            for b in batches:
                held.append(b)
                yield b.column(raw).to_pylist()

        for made in of(values()):
            b = held.pop(0)
            cols = [b.column(c) for c in kept] + [pa.array(v, arrow_type(f.dataType)) for v, f in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=kept + [f.name for f in fields])

    return src.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in t.fields])
    return simple[t.simpleString()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


FILTER_BITS = 22


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be of ``ids``, rows that are surely not), by a bitmap of fixed size, so few rows need a join.

    ``ids`` has one column of keys. Null keys are among the sure ones.
    """
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    word, bits, at = own_names(df, "filter", "word", "bits", "at")
    one = ids.select(spread(F.col(ids.columns[0])).alias(at)).select((F.col(at) / 64).cast("int").alias(word), F.expr(f"shiftleft(1L, cast({at} % 64 as int))").alias(bits))
    held = F.broadcast(one.groupBy(word).agg(F.bit_or(bits).alias(bits)))  # at most 2^16 rows
    rows = df.withColumn(at, spread(F.col(f"`{key}`"))).withColumn(word, (F.col(at) / 64).cast("int")).join(held, word, "left")
    maybe = F.expr(f"{bits} is not null and shiftright({bits}, cast({at} % 64 as int)) & 1 = 1") & F.col(f"`{key}`").isNotNull()
    names = [F.col(f"`{c}`") for c in df.columns]
    return rows.where(maybe).select(*names), rows.where(~maybe).select(*names)
