import itertools

import numpy as np
import pytest

from evidra.llm import neighbours
from evidra.llm.neighbours import hilbert_keys, nearest, op10_nearest
from pyspark.sql import functions as F


def test_hilbert_is_a_walk():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        order = cells[np.argsort(hilbert_keys(cells, bits))]
        assert len(set(hilbert_keys(cells, bits).tolist())) == len(cells)
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def truth(rows, k=20, each=20):
    x = np.array([r[1] for r in rows], np.float64)
    ids = [r[0] for r in rows]
    out = {}
    for i, q in enumerate(ids):
        if q % each == 0:
            s = x @ x[i]
            out[q] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = truth(rows)
    x = {i: np.array(v, np.float64) for i, v in rows}
    got = {}
    for r in op10_nearest(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    print(sf, len(rows), "recall", recall)
    assert recall >= 0.9


def test_repeated_rows(spark):
    """Every row asks for itself and is left out of its own answer alone."""
    rows = [(i, [1.0 + i % 3, float(i % 5), 2.0]) for i in range(30)]
    rows += [rows[0], rows[0], rows[20], (20, [9.0, 9.0, 1.0]), (20, [9.0, 9.0, 1.0]), (7, [9.0, 9.0, 1.0])]
    x = np.array([v for _, v in rows])
    want = []
    for i, (q, _) in enumerate(rows):
        if q % 20 == 0:
            s = x @ x[i]
            best = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != i)[:20]
            want += [(q, n + 1, d, -t) for n, (t, d) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for share in (0.15, 1.0):
        got = [tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, share=share, curves=5 if share < 1 else 1).collect()]
        assert sorted(got) == sorted(want)


def test_blocks_and_windows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = truth(rows)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, queries=7).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_odd_rows(spark):
    good = [(i, [1.0, float(i % 5)]) for i in range(40)] + [(100 + i, [9.0, 9.0]) for i in range(60)]
    bad = [(1000, None), (1020, [0.0, 0.0]), (1040, [float("nan"), 1.0]), (1060, [None, 1.0]), (1080, [float("inf"), 1.0]), (1100, [1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("h", F.lit(1))
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == truth(good)
    assert nearest(df.where("vec_id >= 1000"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [tuple(r)[:3] for r in nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
