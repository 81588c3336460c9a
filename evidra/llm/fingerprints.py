"""Operator 9: threshold-scaled sketches of documents.

A document's sketch is the set of those hashes of its five-word shingles that lie below a fixed fraction of
the hash range; where none does, its smallest hash alone, so only texts without words have an empty sketch.
The fraction is the same for all documents: the sketch of a union is made from the sketches of its parts, and
containment and resemblance of very unequal documents are estimated from the sketches alone.

Defined cases: null text is empty; equal texts have equal sketches and a likeness of 1, also if both are
without words; a text without words is like no other (0). Repeated rows get equal results, and so do texts of
equal sketches (ties); among rows of one key the next document is any other of them; rows of a null key come
last; a key with very many different rows is parted further; very long texts are read whole, one at a time; an empty
table gives an empty one; columns other than key and text aren't read, so none clashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import partitions, table
from evidra.llm.shingles import shingle_hashes, word_hashes

#: One shingle hash in so many is retained; hashes are kept as 48 bits.
SCALE, KEPT_BITS = 4, 48


@dataclass
class Sketch:
    hashes: np.ndarray  # sorted

    @staticmethod
    def _retained(hashes: np.ndarray, scale: int) -> np.ndarray:
        """Of sorted distinct hashes: those below the threshold, or else the smallest."""
        low = int(np.searchsorted(hashes, np.uint64((1 << KEPT_BITS) // scale)))
        return hashes[: max(low, 1)]

    @classmethod
    def of(cls, words: np.ndarray, scale: int = SCALE) -> Sketch:
        h = shingle_hashes(words)
        low = h[h < np.uint64((1 << 64) // scale)]
        low = low if len(low) else h
        return cls(cls._retained(np.unique(low >> np.uint64(64 - KEPT_BITS)), scale))

    def text(self) -> str:
        """Base64 of the retained hashes, 8 characters each."""
        return base64.b64encode(self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Sketch:
        raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
        return cls(np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64))

    def merge(self, other: Sketch, scale: int = SCALE) -> Sketch:
        """The sketch of both documents' shingles together; the order of merges, and repeats, don't matter."""
        return Sketch(self._retained(np.union1d(self.hashes, other.hashes), scale))

    def common(self, other: Sketch) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def resemblance(self, other: Sketch) -> float:
        both = self.common(other)
        union = len(self.hashes) + len(other.hashes) - both
        return both / union if union else 1.0

    def containment(self, other: Sketch) -> float:
        """The share of this document's shingles that the other has."""
        if not len(self.hashes):
            return float(not len(other.hashes))
        return self.common(other) / len(self.hashes)


def with_neighbours(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows (key, text, part, last) in parts by falling key; each part ends with its successor's first row, ``last`` true.

    Parts are cut at quantiles of the key; a key that several quantiles fall on has as many parts of its own.
    Only one row a part is held twice; the quantiles and the first keys of parts come to the driver.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    n = max(1, partitions(spark))
    drawn = Counter(df.approxQuantile(key, [i / n for i in range(1, n)], 0.002 / n**0.5) if n > 1 else [])
    edges = sorted(drawn) or [0.0]  # no rows, or one part
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="at", outputCol="bin", handleInvalid="keep")
    #: bin, its first part, its lower edge, and how many parts rows on that edge have for themselves, after the others
    plan, parts = [], 0
    for b in range(len(edges), -1, -1):
        own = drawn[edges[b - 1]] if b and drawn[edges[b - 1]] > 1 else 0
        plan.append((float(b), parts, edges[b - 1] if own else None, own))
        parts += 1 + own
    plan.append((float(len(edges) + 1), parts, None, 0))  # null keys
    parts += 1
    bins = F.broadcast(spark.createDataFrame(plan, "bin double, first int, edge double, own int"))
    src = cut.transform(src.withColumn("at", F.col("key").cast("double"))).join(bins, "bin")
    alone = (F.col("own") > 0) & (F.col("at") == F.col("edge"))
    home = F.when(alone, F.col("first") + 1 + F.pmod("h", F.greatest("own", F.lit(1))).cast("int")).otherwise(F.col("first"))
    src = src.select("key", "text", "h", home.alias("home"))
    heads = sorted((r.home, r.head) for r in src.groupBy("home").agg(F.max(F.struct(F.col("key").isNotNull().alias("known"), "key", "h")).alias("head")).collect())
    schema = f"home int, head struct<known:boolean,key:{src.schema['key'].dataType.simpleString()},h:bigint>, before int"
    to = [(p, h, heads[i - 1][0]) for i, (p, h) in enumerate(heads)]  # the first one's head follows the last part
    also = F.broadcast(spark.createDataFrame(to, schema))
    own = F.struct(F.col("home").alias("part"), F.lit(False).alias("last"))
    more = F.struct(F.col("before").alias("part"), F.lit(True).alias("last"))
    src = src.join(also, "home")
    first = F.col("key").eqNullSafe(F.col("head.key")) & (F.col("h") == F.col("head.h"))
    src = src.select("key", "text", "h", F.explode(F.when(first, F.array(own, more)).otherwise(F.array(own))).alias("x")).select("key", "text", "h", "x.part", "x.last")
    return src.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "last", F.desc_nulls_last("key"), F.desc("h")).select("key", "text", "part", "last"), parts


def edited_by_next(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, that of its edited text, and how like they and the next document's are."""
    rows, _ = with_neighbours(table(spark, sf_dir, "documents"), "doc_id", "text")
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_edited double, containment_next double"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out: list[tuple] = []
        size = 0
        closed = False
        for b in batches:
            for key, text, last in zip(b.column("key"), b.column("text"), b.column("last"), strict=True):
                if closed:
                    continue
                text, closed = text.as_py(), last.as_py()
                words = word_hashes(text.encode())
                sketch = Sketch.of(words)
                if held is not None:
                    out.append(_row(*held, text, sketch))
                    size += 2 * len(held[1])
                held = (key.as_py(), text, words, sketch)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])
    return rows.mapInArrow(run, fields)


def _row(key, text: str, words: np.ndarray, sketch: Sketch, following: str, after: Sketch) -> tuple:
    k = len(text) // 3
    kept = text[: len(text) - k]
    edited = kept + following[:k]
    cut = max(kept.rfind(c) for c in " \t\n\x0b\x0c\r") + 1  # words that end before it are those of the text itself
    same = len(words) - len(text[cut:].encode().split())
    e = Sketch.of(np.concatenate([words[:same], word_hashes(edited[cut:].encode())]))
    return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.text(), e.text(), sketch.resemblance(e), sketch.resemblance(after), sketch.containment(e), sketch.containment(after))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to any table."""
    from pyspark.sql import types as T

    from evidra.llm.common import with_columns

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        for texts in batches:
            yield [[Sketch.of(word_hashes(t or b"")).text() for t in texts]]

    return with_columns(df, text, [T.StructField("fingerprint", T.StringType())], run)
