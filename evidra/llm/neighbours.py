"""Operator 10: approximate nearest neighbours on shifted space-filling curves.

Vectors are projected by several fixed random rotations to a few dimensions, shifted, and ordered along a
Hilbert curve; each ordering is range-partitioned and cut into blocks of ``share`` of all rows, or into as many
smaller ones as keep a block under ``BLOCK_ROWS``. A query goes, on every curve, to its own block and to those
within ``share`` on either side; a vector goes to one block a curve. The curves' answers merge and are scored
again in double precision. Ranks, not keys, part the blocks, so a crowded place on a curve makes no large block.
A task holds at most some ``queries`` queries, and vectors stream past them in batches, so its memory is bounded.

How wide a window must be depends on the data. Where vectors fill all their dimensions evenly, near ones spread
along any curve in proportion to the rows, and the window is a share of these, the same at every size; where they
lie near fewer dimensions a smaller ``share`` does. A share of 1 on one curve is the exact search.

Equal vectors are searched as one: of each, the k + 1 smallest ids are kept, more than any answer needs, so a
vector with very many copies costs no more than another.

Defined cases: vectors that are null, zero, of another length than the smallest id's, or hold null or non-finite
components take no part, nor do rows of a null id; ties go to the smaller id; repeated ids count as rows, each of
which asks, is found by the others and is left out of its own answer alone; with fewer candidates than k all are
returned (the window then covers all rows); an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.llm.common import partitions, table, written

CURVES, DIMS, BITS, SHARE, QUERIES, BLOCK_ROWS, SEED = 5, 6, 10, 0.15, 4096, 65_536, 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (n x d integers under 2^bits) on the Hilbert curve, as one number.

    Skilling's transform: undo excess work from the top bit down, then Gray-encode, then interleave.
    """
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def curve_keys(vectors: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Keys (n x curves) of unit vectors: each curve has its own rotation and shift, fixed by ``seed``."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(unit), curves), np.int64)
    for c in range(curves):
        axes = np.linalg.qr(rng.standard_normal((unit.shape[1], min(dims, unit.shape[1]))))[0]
        spread = 6 / np.sqrt(unit.shape[1])  # three deviations of a projected unit vector on either side
        at = (unit @ axes) / spread + 0.5
        cells = np.floor((at * 0.5 + rng.random(at.shape[1]) * 0.5) * (1 << bits))
        out[:, c] = hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits).astype(np.int64)
    return out


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision and one fixed order, so equal pairs get equal scores anywhere."""
    out = np.zeros(len(queries))
    for j in range(queries.shape[1] if len(queries) else 0):
        out += queries[:, j].astype(np.float64) * vectors[:, j]
    return out


def ranked(df: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Adds ``rank`` within ``by`` in the order of ``keys``, without one task for all: range parts, then offsets."""
    n = max(1, partitions(df.sparkSession))
    parts = written(df.repartitionByRange(n, by, *keys).withColumn("piece", F.spark_partition_id()), "ann-sorted")
    within = F.row_number().over(W.partitionBy(by, "piece").orderBy(*keys))
    counts = parts.groupBy(by, "piece").count()  # at most curves x parts rows
    before = F.sum("count").over(W.partitionBy(by).orderBy("piece")) - F.col("count")
    offsets = F.broadcast(counts.select(by, "piece", before.alias("before")))
    return parts.withColumn("within", within).join(offsets, [by, "piece"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("before", "within", "piece")


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, curves: int = CURVES, share: float = SHARE, queries: int = QUERIES) -> DataFrame:
    """Columns query_id, rank, vec_id, score for each row that the condition ``is_query`` holds for."""
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    src = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = src.where(F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull()).withColumn("h", F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))).cast("binary"))))
    src = written(src, "ann-rows")
    if (one := src.orderBy("id", "h").select(F.size("v").alias("d")).first()) is not None:
        src = src.where(F.size("v") == one.d)
    few = src.withColumn("n", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("n") <= k + 1)  # limited before it moves
    index = few.groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    asked = src.where("q").select("h").distinct().withColumn("asks", F.lit(True))
    index = written(index.join(asked, "h", "left").select(F.monotonically_increasing_id().alias("name"), "h", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "ann-index")
    total, n_asked = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                keys = curve_keys(_matrix(b.column("v")).astype(np.float64), curves, DIMS, BITS, SEED)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(curves, dtype=np.int32), len(b))), pa.array(keys.T.ravel()), b.column("name").take(pa.array(np.tile(np.arange(len(b)), curves)))], names=["curve", "at", "name"])

    places = ranked(index.select("name", "v").mapInArrow(keyed, "curve int, at long, name long"), "curve", ["at", "name"])
    places = places.groupBy("name").agg(F.collect_list(F.struct("curve", "rank")).alias("places"))  # one a curve
    reach = max(int(total * share), k + 1)
    near = -(-reach // BLOCK_ROWS)  # blocks on either side
    rows = -(-reach // near)
    last = max(0, (total - 1) // rows)
    slices = max(1, -(-n_asked * min(2 * near + 1, last + 1) // ((last + 1) * queries)))
    block = (F.col("place.rank") / rows).cast("int")
    own_slice = F.pmod(F.xxhash64("name"), F.lit(slices)).cast("int")
    to = lambda b, s, kind: F.struct(b.alias("block"), s.alias("slice"), F.lit(kind).alias("kind"))
    held = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: to(block, s, 1))
    asking = F.transform(F.sequence(F.greatest(F.lit(0), block - near), F.least(F.lit(last), block + near)), lambda b: to(b, own_slice, 0))
    met = index.select("name", "v", "asks").join(places, "name").select("name", "v", "asks", F.explode("places").alias("place"))
    met = met.select("place.curve", "name", "v", F.explode(F.when(F.col("asks"), F.concat(asking, held)).otherwise(held)).alias("to")).select("curve", "to.*", "name", "v")
    met = met.repartition(max(1, partitions(df.sparkSession)), "curve", "block", "slice").sortWithinPartitions("curve", "block", "slice", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if held is not None and held.best is not None:
                q, s, n = held.answers()
                for a in range(0, len(q), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (q, n, s)], names=["qn", "name", "score"])

        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("curve", "block", "slice", "kind")], 1).astype(np.int64)
            if not len(key):
                continue
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:]):
                if at != tuple(key[a, :3]):
                    yield from out()
                    at, held = tuple(key[a, :3]), Best(k + 1)  # the query's own vector may be among them
                if key[a, 3] and not held.names:
                    continue  # no query here
                names, v = b.column("name").slice(a, z - a).to_numpy(), _matrix(b.column("v").slice(a, z - a))
                if key[a, 3]:
                    held.see(names, v)
                else:
                    held.ask(names, v)
        yield from out()

    found = met.mapInArrow(search, "qn long, name long, score double").dropDuplicates(["qn", "name"])
    pairs = found.join(index.select("name", "ids"), "name").select("qn", "name", "score", "ids", F.posexplode("ids").alias("pos", "vec_id"))
    #: of equal vectors' rows with the query's id, the first stands for the query's own row
    pairs = pairs.select("qn", "score", "vec_id", ((F.col("name") == F.col("qn")) & ((F.col("pos") == 0) | (F.get("ids", F.col("pos") - 1) != F.col("vec_id")))).alias("own"))
    rank = F.row_number().over(W.partitionBy("qn").orderBy(F.desc("score"), "vec_id", F.desc("own")))
    short = pairs.withColumn("n", rank).where(F.col("n") <= k + 1).join(index.select(F.col("name").alias("qn"), F.col("h").alias("qh")), "qn")
    asking = src.where("q").select(F.col("h").alias("qh"), F.col("id").alias("query_id"), F.monotonically_increasing_id().alias("row"))
    answers = asking.join(short, "qh").where(~(F.col("own") & (F.col("vec_id") == F.col("query_id"))))
    rank = F.row_number().over(W.partitionBy("row").orderBy("n"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length without nulls, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Best:
    """The best ``m`` vectors seen so far of each of a few thousand queries."""

    def __init__(self, m: int) -> None:
        self.m, self.names, self.vectors = m, [], []
        self.q = self.best = self.who = self.held = None

    def ask(self, names: np.ndarray, v: np.ndarray) -> None:
        self.names.append(names)
        self.vectors.append(v)

    def see(self, names: np.ndarray, v: np.ndarray) -> None:
        if self.q is None:
            self.q = np.concatenate(self.vectors)
            n = len(self.q)
            self.best, self.who, self.held = np.full((n, self.m), -np.inf), np.full((n, self.m), -1, np.int64), np.zeros((n, self.m, self.q.shape[1]), self.q.dtype)
        step = max(256, 4_000_000 // len(self.q))
        for s in range(0, len(v), step):
            self._see(names[s : s + step], v[s : s + step])

    def _see(self, names: np.ndarray, v: np.ndarray) -> None:
        got = self.q @ v.T
        m = min(self.m, got.shape[1])
        top = np.argpartition(-got, m - 1, axis=1)[:, :m]
        rows = np.arange(len(got))[:, None]
        best = np.concatenate([self.best, got[rows, top]], axis=1)
        who = np.concatenate([self.who, names[top]], axis=1)
        held = np.concatenate([self.held, v[top]], axis=1)
        keep = np.argpartition(-best, self.m - 1, axis=1)[:, : self.m]
        self.best, self.who, self.held = best[rows, keep], who[rows, keep], held[rows, keep]

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, vector), scored again row by row."""
        q, at = np.nonzero(self.who >= 0)
        return np.concatenate(self.names)[q], exact_scores(self.q[q], self.held[q, at]), self.who[q, at]


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose vec_id is divisible by 20, among all other rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
