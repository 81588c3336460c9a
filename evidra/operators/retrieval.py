"""Retrieval operators as DataFrame plans: BM25, dense and sparse top-k, weighted rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.sources.shared import shared_folder

#: The ranking's constants.
K1, B, RRF_K = 1.5, 0.75, 60


def terms(text: Column) -> Column:
    """``[A-Za-z0-9_]+`` runs, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


@dataclass(frozen=True)
class Postings:
    """Of the terms that the queries ask for; ``asked``: (query_id, term, qtf), ``tf``: (term, doc_id, dl, tf)."""

    asked: DataFrame
    tf: DataFrame
    df: DataFrame
    stats: DataFrame


def postings(docs: DataFrame, queries: DataFrame) -> Postings:
    """(doc_id, text), (query_id, text): the corpus is read and cut into words once, for all rankings that follow.

    The written table holds the asked terms' counts and, under a null term, a row for each document with its length.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    known = asked.select("term").distinct().withColumn("known", F.lit(True))
    words = F.coalesce(terms(F.col("text")), F.array().cast("array<string>"))
    base = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("term"))
    rows = base.join(known, "term", "left").where("term is null or known").groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    spark = docs.sparkSession
    at = shared_folder(spark, "postings")
    rows.write.parquet(at)
    kept = spark.read.schema(rows.schema).parquet(at)
    tf = kept.where("term is not null")
    stats = kept.where("term is null").agg(F.sum("tf").alias("n"), F.greatest(F.sum(F.col("dl") * F.col("tf")) / F.sum("tf"), F.lit(1.0)).alias("avgdl"))
    return Postings(asked, tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)


def top(df: DataFrame, k: int, query: str, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query; limited on each task before rows move."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


#: Cells of the matrix of asked terms and queries that goes to all tasks, and of a block of documents and terms.
MATRIX, BLOCK = 1 << 24, 1 << 22


def _blocks(p: Postings, weight: Callable, cell: Callable, k: int) -> DataFrame | None:
    """(query_id, doc_id, score): of every task the ``k`` best documents of each query; None where the queries' matrix is too large.

    A document's asked terms meet all queries in one product of matrices, so its sums are done where it lies and only
    ``k`` rows a query leave a task. ``weight``: (df, n) of terms to what a term asked once weighs; ``cell``:
    (tf, dl, avgdl) to what it is worth in a document.
    """
    spark = p.tf.sparkSession
    terms_, queries_ = p.asked.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
    if terms_ * queries_ > MATRIX:
        return None
    stats = p.stats.first()
    if not stats.n or not terms_:
        return spark.createDataFrame([], T.StructType([p.asked.schema["query_id"], p.tf.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    df = {r.term: r.df for r in p.df.collect()}  # asked terms that occur
    rows = [r for r in p.asked.collect() if r.term in df]
    term = {t: i for i, t in enumerate(sorted(df))}
    query = sorted({r.query_id for r in rows})
    at = {q: i for i, q in enumerate(query)}
    each = weight(np.array([df[t] for t in sorted(df)], float), float(stats.n))
    matrix = np.zeros((len(term), len(query)))
    for r in rows:
        matrix[term[r.term], at[r.query_id]] = r.qtf * each[term[r.term]]
    avgdl = float(stats.avgdl)
    shared = spark.sparkContext.broadcast((matrix, term, query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, index, queries = shared.value
        size = max(16, BLOCK // max(1, len(index)))
        best: list[list[tuple[float, str, object]]] = [[] for _ in queries]
        docs: list = []
        cells: list[tuple[list, list, list, list]] = []

        def scored() -> None:
            if not docs:
                return
            row, col, tf, dl = (np.concatenate(x) for x in zip(*cells))
            d = np.zeros((len(docs), len(index)))
            d[row, col] = cell(tf.astype(float), dl.astype(float), avgdl)
            found = (d @ m).T
            for q in range(len(queries)):
                hit = np.flatnonzero(found[q] > 0)
                if len(hit) > 4 * k:
                    least = np.partition(found[q][hit], len(hit) - k)[len(hit) - k] - 1e-5  # what rounds to the same stays
                    hit = hit[found[q][hit] >= least]
                best[q] = sorted([*best[q], *((-round(float(found[q][i]), 6), str(docs[i]), docs[i]) for i in hit)], key=lambda x: x[:2])[:k]
            docs.clear()
            cells.clear()

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("doc_id").to_pylist()
            place = []
            for x in ids:  # a document's rows lie together
                if not docs or docs[-1] != x:
                    docs.append(x)
                place.append(len(docs) - 1)
            cells.append((np.array(place), np.fromiter((index[t] for t in b.column("term").to_pylist()), np.int64, len(ids)), b.column("tf").to_numpy(), b.column("dl").to_numpy()))
            if len(docs) >= size:
                last = docs[-1]  # may go on in the next batch
                row, col, tf, dl = (np.concatenate(x) for x in zip(*cells))
                stay = row == len(docs) - 1
                cells[:] = [(row[~stay], col[~stay], tf[~stay], dl[~stay])]
                docs.pop()
                scored()
                docs.append(last)
                cells.append((np.zeros(int(stay.sum()), np.int64), col[stay], tf[stay], dl[stay]))
        scored()
        out = [(q, d, -s) for q, xs in zip(queries, best) for s, _, d in xs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["query_id", "doc_id", "score"])

    schema = T.StructType([p.asked.schema["query_id"], p.tf.schema["doc_id"], T.StructField("score", T.DoubleType())])
    kinds = [pa.int64() if f.dataType.typeName() == "long" else pa.int32() if f.dataType.typeName() == "integer" else pa.string() if f.dataType.typeName() == "string" else pa.float64() for f in schema.fields]
    docs_together = p.tf.select("doc_id", "dl", "term", "tf").repartition("doc_id").sortWithinPartitions("doc_id")
    return docs_together.mapInArrow(run, schema)


def bm25(p: Postings, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank; ties by doc_id as a string.

    Where the queries are too many for a matrix, frequencies and queries are joined to each other first: that side has
    a row for each asked term of a query, which Spark broadcasts while its own size check allows it.
    """
    order = (F.desc("score"), F.col("doc_id").cast("string"))
    found = _blocks(p, lambda df, n: np.log(1 + (n - df + 0.5) / (df + 0.5)), lambda tf, dl, avg: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg)), k)
    if found is not None:
        return top(found, k, "query_id", *order)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    asked = p.asked.join(p.df, "term").crossJoin(F.broadcast(p.stats))  # one row of statistics
    scored = p.tf.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * idf * part).alias("score"))
    return top(scored.withColumn("score", F.round("score", 6)), k, "query_id", *order)


#: Vectors and queries that meet in one task, and cells of a product of theirs that are held at once.
SLICE, ASKED, PRODUCT = 1 << 13, 1 << 13, 1 << 20


def _rows(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length of vectors without nulls: their rows, the vectors as a matrix and their norms, summed in the order of the components."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    size = pc.list_value_length(a).fill_null(-1).to_numpy(zero_copy_only=False).copy()
    values, parent = pc.list_flatten(a).cast(pa.float64()), pc.list_parent_indices(a).to_numpy()
    holes = pc.is_null(values).to_numpy(zero_copy_only=False)
    size[parent[holes]] = -1
    flat, first = values.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(a)))])
    out = {}
    for n in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == n)
        m = flat[first[at][:, None] + np.arange(n)]
        norm = np.zeros(len(at))
        for i in range(n):
            norm += m[:, i] * m[:, i]
        out[n] = (at, m, np.sqrt(norm))
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves up in decimal, as Spark rounds."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def _nearest(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, vectors, scores, which have none) by row: of each query the ``k`` best of these vectors, equal ones by id.

    A product of matrices leaves out what is below the k-th best by more than rounding; the others are summed in order.
    """
    mine, asked = _rows(left.column("v")), _rows(right.column("q"))
    ids, queries = left.column("id").to_numpy(), right.column("query_id").to_numpy()
    place = np.unique(ids, return_inverse=True)[1]
    none_at = np.zeros(0, np.int64)
    parts = [(n, at) for n, (at, _, _) in asked.items()]
    parts.append((None, np.setdiff1d(np.arange(len(queries)), np.concatenate([none_at, *(at for _, at in parts)]))))
    step = max(1, PRODUCT // len(ids))
    for n, rows in parts:
        at, m, norm = mine.get(n, (none_at, None, None))
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            key = np.full((len(some), len(ids)), -np.inf)  # no score: behind all others
            if len(at):
                q, qn = asked[n][1][s : s + step], asked[n][2][s : s + step]
                score = (q @ m.T) / (qn[:, None] * norm)
                score[np.isnan(score)] = np.inf  # not a number: before all others
                key[:, at] = score
            key[queries[some][:, None] == ids] = -np.inf
            least = np.partition(key, len(ids) - k, axis=1)[:, [len(ids) - k]] - 2e-6 if len(ids) > k else -np.inf
            i, j = np.nonzero(key >= least)
            other = queries[some][i] != ids[j]
            i, j = i[other], j[other]
            value, none = np.zeros(len(i)), np.ones(len(i), bool)
            if len(at):
                where = np.full(len(ids), -1)
                where[at] = np.arange(len(at))
                none = where[j] < 0
                a, b = np.where(none, 0, where[j]), i
                for c in range(n):
                    value += m[a, c] * q[b, c]
                value = value / (norm[a] * qn[b])
            nan = np.isnan(value) & ~none
            order = np.lexsort((place[j], np.where(nan | none, 0, -_rounded(np.where(nan, 0, value))), np.where(none, 2, np.where(nan, 0, 1)), i))
            i, j, value, none = i[order], j[order], value[order], none[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield some[i[keep]], j[keep], value[keep], none[keep]


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(id, v) against the stated queries (query_id, q) by cosine; ties by id.

    Every slice of the vectors meets every block of the queries in a task that gives out the ``k`` best of the slice, so
    all pairs are scored and few rows move. A vector that is null, holds a null or has another length than the query has
    no score and comes last; one without length or of infinite length has NaN and comes first.
    """
    left, right = vectors.select("id", "v").where("id is not null"), queries.select("query_id", "q").where("query_id is not null")
    slices, blocks = -(-left.count() // SLICE), -(-right.count() // ASKED)
    schema = T.StructType([right.schema["query_id"], left.schema["id"], T.StructField("score", T.DoubleType())])
    if not slices or not blocks:
        found = vectors.sparkSession.createDataFrame([], schema)
        return top(found, k, "query_id", F.desc("score"), F.col("id"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("slice", part("id", slices)).withColumn("block", every(blocks))
    right = right.withColumn("block", part("query_id", blocks)).withColumn("slice", every(slices))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([b.column("query_id").slice(0, 0), a.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        with np.errstate(all="ignore"):
            i, j, score, none = (np.concatenate(x) for x in zip(*_nearest(a, b, k)))
        return pa.table([b.column("query_id").take(pa.array(i)), a.column("id").take(pa.array(j)), pa.array(score, mask=none)], names)

    cell = ("slice", "block")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, schema)
    return top(found.withColumn("score", F.round("score", 6)), k, "query_id", F.desc("score"), F.col("id"))


def fused(first: DataFrame, second: DataFrame, weights: tuple[float, float], k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings (query_id, doc_id, score, rank), with both ranks."""
    a = first.select("query_id", "doc_id", F.col("score").alias("s1"), F.col("rank").alias("r1"))
    b = second.select("query_id", "doc_id", F.col("score").alias("s2"), F.col("rank").alias("r2"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (rrf_k + F.col(r)), F.lit(0.0))
    out = both.select("query_id", "doc_id", F.round(part(weights[0], "r1") + part(weights[1], "r2"), 9).alias("fusion"), F.greatest("s1", "s2").alias("best"), "r1", "r2")
    return top(out, k, "query_id", F.desc("fusion"), F.desc("best"), F.col("doc_id").cast("string"))


def tfidf(p: Postings, k: int = 10) -> DataFrame:
    """Sparse dot product of tf-idf weights; see ``bm25`` for how."""
    order = (F.desc("score"), F.col("doc_id").cast("string"))
    found = _blocks(p, lambda df, n: (np.log((n + 1) / (df + 1)) + 1) ** 2, lambda tf, dl, avg: tf, k)
    if found is not None:
        return top(found, k, "query_id", *order)
    asked = p.asked.join(p.df, "term").crossJoin(F.broadcast(p.stats))  # one row of statistics
    w = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    scored = p.tf.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("tf") * F.col("qtf") * w * w), 6).alias("score"))
    return top(scored, k, "query_id", *order)
