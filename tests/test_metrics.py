import math
import random

import pytest
from pyspark.sql import functions as F

from evidra.functions import metrics as M
from evidra.plans.registry import QUERIES


def test_registry_gates_by_columns(spark):
    r = M.standard()
    r.register("length", ["response"], lambda: F.char_length("response"))
    r.register("judged", ["response", "reference"], lambda: F.lit(1.0))
    with pytest.raises(ValueError, match="already"):
        r.register("length", [], lambda: F.lit(0))
    kept, left = r.resolve(["response", "retrieved_context_ids", "reference_context_ids"])
    assert [m.name for m in kept] == ["retrieval_recall_at_k", "retrieval_ndcg_at_10", "length"] and left == [("judged", "missing required columns: reference")]
    with pytest.raises(KeyError, match="nothing"):
        r.resolve(["response"], ["nothing"])
    with pytest.raises(ValueError, match="reference"):
        r.resolve(["response"], ["judged"], gate=False)
    with pytest.raises(ValueError, match="no metric"):
        r.resolve(["other"])
    rows = spark.createDataFrame([("a", "xy", False), ("a", "", None), ("a", "zzzz", True), ("b", None, False)], "c string, response string, bad boolean")
    got = {x.c: x.asDict() for x in M.condition_summary(rows, "c", F.col("bad"), r).collect()}
    assert got == {"a": {"c": "a", "n_rows": 3, "success": 2, "failed": 1, "length": 2.0}, "b": {"c": "b", "n_rows": 1, "success": 1, "failed": 0, "length": None}}


CASES = [
    (["doc-1", "doc-3", "doc-2"], ["doc-1", "doc-2"], 1.0, (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))),
    ([" a ", "a", None, "", "b"], ["b", "c"], 0.5, (1 / math.log2(3)) / (1 + 1 / math.log2(3))),
    ([], ["a"], 0.0, 0.0), (None, ["a"], 0.0, 0.0), (["a"], [], None, None), (["a"], None, None, None), (["a"], [" ", None], None, None),
    ([f"x{i}" for i in range(10)] + ["a"], ["a"], 1.0, 0.0), ([f"x{i}" for i in range(12)], [f"x{i}" for i in range(12)], 1.0, 1.0),
]


def test_recall_and_ndcg(spark):
    rows = [(i, a, b) for i, (a, b, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, retrieved_context_ids array<string>, reference_context_ids array<string>")
    near = lambda a, b: a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-12
    got = {r.i: r for r in M.standard().scored(df).collect()}
    for i, (_, _, recall, ndcg) in enumerate(CASES):
        assert near(got[i].retrieval_recall_at_k, recall) and near(got[i].retrieval_ndcg_at_10, ndcg), i
    hits = df.select(F.col("i").alias("query_id"), F.posexplode(M.ids(F.col("retrieved_context_ids"))).alias("rank", "id"))
    relevant = df.select(F.col("i").alias("query_id"), F.explode(M.ids(F.col("reference_context_ids"))).alias("id"))
    table = {r.query_id: r for r in M.retrieval_scores(hits, relevant, 10).collect()}
    assert {i for i, c in enumerate(CASES) if c[2] is not None} == set(table)
    for i, r in table.items():
        first = len(set(CASES[i][1]) & {x.strip() for x in (CASES[i][0] or []) if x} - {f"x{j}" for j in range(10, 12)} - ({"a"} if i == 7 else set()))
        assert near(r.ndcg, CASES[i][3]) and (i > 6 or near(r.recall, CASES[i][2])) and near(r.recall, first / len({x for x in CASES[i][1] if x and x.strip()}))


def test_scores_by_group(spark):
    """The same as with the lists spelt out, for ids and queries of several groups or none; rows are never as many as the lists."""
    r = random.Random(3)
    members = [(i, r.choice("abc")) for i in range(400)] + [(i, r.choice("abc")) for i in range(0, 400, 7)] + [(400, None), (None, "a"), (3, "d")]
    asked = [(q, r.choice("abc")) for q in range(20)] + [(0, "a"), (0, "b"), (21, "none"), (22, None), (23, "d")]
    hits = [(q, i, n + 1) for q in range(20) for n, i in enumerate(r.sample(range(400), 12))] + [(23, 5, 1), (23, 3, 2), (23, 3, 3), (30, 1, 1)]
    m, a = spark.createDataFrame(members, "id int, group string"), spark.createDataFrame(asked, "query_id int, group string")
    h = spark.createDataFrame(hits, "query_id int, id int, rank int")
    for k in (5, 10):
        want = {x.query_id: x for x in M.retrieval_scores(h, a.join(m.where("id is not null"), "group"), k).collect()}
        got = {x.query_id: x for x in M.group_scores(h, a, m, k).collect()}
        assert set(got) == set(want) == {*range(20), 23}
        assert all(abs(got[q].recall - want[q].recall) < 1e-12 and abs(got[q].ndcg - want[q].ndcg) < 1e-12 for q in want)


@pytest.mark.parametrize("name", ["ndcg_at_10", "recall_at_k"])
def test_lists_are_not_made(spark, tmp_path, name):
    """Embeddings are joined to the queries' labels as counts: no join of all vectors with all queries by label."""
    n = 3000
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == n // 100 and all(x[1] == (1.0 if name == "ndcg_at_10" else round(5 / n, 9)) for x in rows)
    plan = df._jdf.queryExecution().executedPlan()
    most = 0
    todo = [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while todo:
        p = todo.pop()
        if p.metrics().contains("numOutputRows") and "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        p = p.plan() if "QueryStage" in p.nodeName() else p
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert 0 < most <= n
