"""Retrieval operators applied to the driver's tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import retrieval as R


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _asked(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _postings(spark, sf_dir):
    return R.postings(_t(spark, sf_dir, "documents"), _asked(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(_postings(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tfidf(_postings(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _dense_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest documents of every benchmark item: the vector of a document or an item is that of its id."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    docs = e.join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    asked = e.join(_asked(spark, sf_dir).select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return R.dense(docs, asked, 20).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and BM25, equal weights."""
    return R.fused(_dense_documents(spark, sf_dir), R.bm25(_postings(spark, sf_dir), 20), (1.0, 1.0)).select("query_id", "doc_id", "fusion", "rank", F.col("r1").alias("dense_rank"), F.col("r2").alias("bm25_rank"))


def hybrid_sparse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse, the sparse side weighted twice."""
    return R.fused(_dense_documents(spark, sf_dir), R.tfidf(_postings(spark, sf_dir), 20), (1.0, 2.0)).select("query_id", "doc_id", "fusion", "rank", F.col("r1").alias("dense_rank"), F.col("r2").alias("sparse_rank"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.aggregate(F.transform(v, lambda x: x / norm), F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


_POST = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) x GROUP BY 1, 2), l AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM l)"
_BM = f"{_POST}, bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2)"
_TI = "ti AS (SELECT query_id, doc_id, round(sum(tf * qtf * pow(ln((n + 1)::double / (df + 1)) + 1, 2)), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2)"


def _ranked(t: str) -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::varchar) AS rank FROM {t}"


_DENSE = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(d.v, q.v), 6) AS score FROM e d JOIN e q ON q.vec_id <> d.vec_id AND q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 20)"
_FUSED = "SELECT query_id, doc_id, fusion, rank, dense_rank, {name} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, best DESC, doc_id::varchar) AS rank FROM (SELECT query_id, doc_id, round(coalesce({w1}::double / (60 + a.rank), 0) + coalesce({w2}::double / (60 + b.rank), 0), 9) AS fusion, greatest(a.score, b.score) AS best, a.rank AS dense_rank, b.rank AS {name} FROM a FULL JOIN b USING (query_id, doc_id))) WHERE rank <= 10"


QUERIES = {f.__name__: f for f in (bm25_topk, sparse_topk, dense_topk, hybrid_rrf, hybrid_sparse_rrf, l2_normalize)}
SQL = {
    "bm25_topk": f"WITH {_BM} SELECT query_id, doc_id, score, rank FROM ({_ranked('bm')}) WHERE rank <= 10",
    "sparse_topk": f"WITH {_POST}, {_TI} SELECT query_id, doc_id, score, rank FROM ({_ranked('ti')}) WHERE rank <= 10",
    "dense_topk": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 10",
    "hybrid_rrf": f"WITH {_BM}, {_DENSE}, b AS (SELECT * FROM ({_ranked('bm')}) WHERE rank <= 20) {_FUSED.format(w1='1.0', w2='1.0', name='bm25_rank')}",
    "hybrid_sparse_rrf": f"WITH {_POST}, {_TI}, {_DENSE}, b AS (SELECT * FROM ({_ranked('ti')}) WHERE rank <= 20) {_FUSED.format(w1='1.0', w2='2.0', name='sparse_rank')}",
    "l2_normalize": "SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS unit_sum FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))",
}
