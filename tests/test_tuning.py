import math

import pytest
from pyspark.sql import functions as F

from evidra.operators import reranking as K
from evidra.operators import tuning as U
from evidra.plans import rule_queries as R


def test_grids():
    assert len(U.first_trials()) == 54 and len(U.first_trials("core")) == 25 == len(U.first_trials("two_phase"))
    assert U.first_trials("core")[0] == dict.fromkeys(K.FEATURES, 0.0)
    anchors = [{"authority": 0.04, "scope": 0.0, "status": 0.08, "freshness": 0.5}, {"authority": 0.04, "scope": 0.0, "status": 0.08}]
    assert len(U.second_trials(anchors)) == 24 and U.second_trials(anchors)[0]["freshness"] == 0.0
    with pytest.raises(ValueError):
        U.first_trials("other")


def test_against_the_reranker(spark, sf_dir):
    """Every trial's measures from the reranker itself, run under its weights."""
    relevant = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 12").select(F.floor(F.col("p_partkey") / 20).alias("query_id"), F.col("p_partkey").cast("string").alias("id"))
    judged = {(r.query_id, r.id) for r in relevant.collect()}
    trials = [{}, {"authority": 0.3, "freshness": 0.2, "scope": 0.1}, R.WEIGHTS]
    inputs = R.candidates(spark, sf_dir)
    run = lambda w: K.validity_rerank(*inputs, w, R.AUTHORITY, R.STATUS)
    got = {r.trial: r for r in U.offline_trials(run({}), relevant, trials, 6).collect()}
    for i, w in enumerate(trials):
        by = {}
        for r in run(w).select("query_id", "id", "place").collect():
            by.setdefault(r.query_id, []).append((r.place, (r.query_id, r.id) in judged))
        recall, ndcg = [], []
        for rows in by.values():
            n = sum(h for _, h in rows)
            if n:
                first = [p for p, h in sorted(rows)[:6] if h]
                recall.append(len(first) / n)
                ndcg.append(sum(1 / math.log2(p + 1) for p in first) / sum(1 / math.log2(p + 2) for p in range(min(n, 6))))
        assert got[i].prepared_rows == len(recall) > 3
        assert abs(got[i].recall - sum(recall) / len(recall)) < 1e-9 and abs(got[i].ndcg - sum(ndcg) / len(ndcg)) < 1e-9 and abs(got[i].objective - (got[i].recall + got[i].ndcg) / 2) < 1e-12
    none = U.offline_trials(run({}), relevant.limit(0), trials).collect()
    assert [(r.prepared_rows, r.recall, r.objective) for r in none] == [(0, None, float("-inf"))] * 3


def test_best_and_anchors(spark):
    names = ", ".join(f"{f} double" for f in K.FEATURES)
    row = lambda i, objective, precision, faith, rows, **w: (i, *[w.get(f, 0.0) for f in K.FEATURES], objective, precision, faith, rows)
    rows = [
        row(0, 0.5, 0.4, 0.4, 70, authority=0.1), row(1, 0.5, 0.4, 0.4, 70, authority=0.2), row(2, 0.5, 0.4, 0.4, 70, scope=0.1), row(3, 0.5, 0.3, 0.9, 70), row(4, 0.9, 0.9, 0.9, 10, status=0.1),
        row(5, 0.5, None, 0.4, 70), row(6, 0.5, float("nan"), 0.4, 70), row(7, 0.4, 0.1, 0.4, 70, authority=0.1, freshness=0.1), row(8, float("-inf"), None, None, 99, status=0.7),
    ]
    df = spark.createDataFrame(rows, f"trial long, {names}, objective double, precision double, faith double, prepared_rows long")
    plain, guarded = U.ordering("precision", "faith"), U.ordering("precision", "faith", ("faith",), 60)
    assert U.best_trial(df, plain).first().trial == 4 and U.best_trial(df, guarded).first().trial == 3
    assert [r.trial for r in df.where("trial not in (4)").orderBy(*plain).collect()][:3] == [0, 2, 1]
    assert [r.trial for r in U.anchor_trials(df, guarded, 3).collect()] == [3, 0, 2]
    assert [r.trial for r in U.anchor_trials(df, guarded, 1, 1000).collect()] == [3]
    with pytest.raises(ValueError):
        U.best_trial(df.limit(0), plain)
