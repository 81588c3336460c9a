import zlib

import numpy as np
from pyspark.sql import functions as F

from evidra.llm.quality import BINS, N_FEATURES, best_bin, features, fit, keep_good, op4_quality, score_quality, statistics, train


def auc(s, y):
    r = np.argsort(np.argsort(s)) + 1.0
    p = y == 1
    return (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_positive_unlabelled_on_two_clouds():
    rng = np.random.default_rng(0)
    a, b = rng.normal(1.5, 1, (3000, 5)), rng.normal(-1.5, 1, (3000, 5))
    model = fit(a[:1500], np.concatenate([a[1500:2200], b[:300]]), 0.7, steps=300)
    assert (model.scores(a[2200:]) >= 0.5).mean() > 0.95 and (model.scores(b[300:]) < 0.5).mean() > 0.95


def test_prior_of_two_clouds():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        a, b = rng.normal(1.5, 1, (6000, 5)), rng.normal(-1.5, 1, (6000, 5))
        unlabelled = np.concatenate([a[2000 : 2000 + int(4000 * share)], b[: int(4000 * (1 - share))]])
        m = fit(a[:1000], unlabelled[::2], 0.5, steps=80)
        spread = lambda x: np.histogram(m.scores(x), BINS, (0, 1))[0].astype(float)
        assert abs(best_bin(spread(a[1000:2000]), spread(unlabelled[1::2])) - share) < 0.07  # rows that it hasn't learnt from


def test_features():
    for t in (b"", b" ", b"\n", "é ü".encode(), b"x" * 100_000, b"\x00\xff"):
        assert len(features(t)) == N_FEATURES and np.isfinite(features(t)).all()


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op4_quality(spark, d).collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in rows.items())
    y = [(rows[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    s, q = np.array([a for a, _ in y]), np.array([b for _, b in y])
    print("held out", len(y), "auc", auc(s, q), "accuracy", ((s >= 0.5) == q).mean(), "kept good", (s[q == 1] >= 0.5).mean(), "kept bad", (s[q == 0] >= 0.5).mean())
    assert auc(s, q) > 0.97 and ((s >= 0.5) == q).mean() > 0.95


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a b", 3), (3, "a b", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    model = train(statistics(df), labels)
    got = sorted(score_quality(df, model).collect(), key=lambda r: r.doc_id)
    assert got[0].score == got[1].score and got[2].score == got[3].score and got[2].doc_id == 3
    none = train(statistics(df), labels.limit(0))
    assert none is None and {r.score for r in score_quality(df, none).collect()} == {0.5}
    assert score_quality(df.limit(0), model).count() == 0
    assert train(statistics(df.limit(0)), labels) is None
    kept = keep_good(df.withColumn("predicted", F.lit("mine")).withColumnRenamed("score", "Score"), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "Score", "predicted"] and sorted(r.Score for r in kept.collect()) == [1, 2, 3, 3]
    with_null = df.unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    assert len({r.score for r in score_quality(with_null, model).where("text = 'a b'").collect()}) == 1


def test_prior_of_the_corpus(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = train(statistics(spark.read.parquet(f"{d}/documents.parquet")).cache(), labels)
    share = labels.agg(F.avg("quality")).first()[0]
    print("prior", model.prior, "share of the labels", share)
    assert abs(model.prior - share) < 0.1
