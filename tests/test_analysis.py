import pytest
from pyspark.sql import functions as F

from evidra.operators import analysis as A
from evidra.operators import positions as P


def test_annotations(spark):
    examples = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    notes = spark.createDataFrame([("a", "dev", None), ("b", "test", "x"), ("c", "dev", "y")], "id string, split string, notes string")
    got = {r.id: r.benchmark_annotation for r in A.annotated(examples, notes).collect()}
    assert {k: (v.split, v.notes) for k, v in got.items()} == {"a": ("dev", None), "b": ("test", "x")}
    with pytest.raises(Exception, match="no annotation for id b"):
        A.annotated(examples, notes.where("id <> 'b'")).collect()


def test_rows_beside_scores(spark):
    prepared = P.row_index(spark.createDataFrame([(f"q{i}", "r") for i in range(5)], "id string, response string"), [F.col("id")])
    scores = P.row_index(spark.createDataFrame([(f"q{i}", ["0.5", "nan", "", "x", "1"][i]) for i in range(5)], "id string, faithfulness string"), [F.col("id")])
    rows = A.analysis_rows(prepared, scores, {"condition_name": "c1"})
    assert sorted((r.place, r.id, r.faithfulness, r.condition_name) for r in rows.collect()) == [(0, "q0", 0.5, "c1"), (1, "q1", None, "c1"), (2, "q2", None, "c1"), (3, "q3", None, "c1"), (4, "q4", 1.0, "c1")]
    with pytest.raises(ValueError):
        A.analysis_rows(prepared, scores.where("place > 0"), {})


def test_subgroups(spark):
    rows = spark.createDataFrame([("c", "docs", " yes ", 1.0), ("c", "docs", "", float("nan")), ("c", "both", None, 0.0), ("d", "docs", "no", None)], "c string, source_needed string, validity_sensitive string, m double")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in A.subgroup_means(rows, "c", ["source_needed", "validity_sensitive"], ["m"]).collect()}
    assert got == {("c", "__all__", "all"): (3, 0.5), ("c", "source_needed", "docs"): (2, 1.0), ("c", "source_needed", "both"): (1, 0.0), ("c", "validity_sensitive", "yes"): (1, 1.0), ("d", "__all__", "all"): (1, None), ("d", "source_needed", "docs"): (1, None), ("d", "validity_sensitive", "no"): (1, None)}
