import os

from pyspark.sql import functions as F

from evidra.sources.store import Buckets, put_or_report

SCHEMA = "id string, parent string, v long, text string"


def times(root):
    return {d: max(os.stat(f"{root}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{root}/{d}")) for d in os.listdir(root) if d.startswith("bucket=")}


def test_a_batch_writes_its_own_folders(spark, tmp_path):
    root = f"{tmp_path}/s"
    s = Buckets(spark, f"file://{root}", "id", "v", 8)
    assert s.read() is None and s.put(spark.createDataFrame([], SCHEMA)) == 0
    rows = [(f"k{i}", f"p{i % 10}", 1, "a") for i in range(100)]
    assert s.put(spark.createDataFrame(rows, SCHEMA)) == 8
    before = times(root)
    batch = spark.createDataFrame([("k5", "p5", 2, "new"), ("k5", "p5", 1, "late")], SCHEMA)
    assert s.put(batch) == s.put(batch) == 1
    after = times(root)
    assert sum(after[d] != before[d] for d in before) == 1 and set(after) == set(before)
    got = {r.id: (r.v, r.text) for r in s.read().collect()}
    assert len(got) == 100 and got["k5"] == (2, "new") and got["k6"] == (1, "a") and s.read().columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    s.remove(spark.createDataFrame([("k7",), ("p3",)], "x string"), "parent")
    left = {r.id for r in s.read().collect()}
    assert left == {f"k{i}" for i in range(100)} - {"k7"} - {f"k{i}" for i in range(3, 100, 10)}
    s.remove(s.read().select("id"), "parent")
    assert s.read() is None


def test_bad_rows_alone_are_reported(spark, tmp_path):
    s = Buckets(spark, f"file://{tmp_path}/s", "id", "v", 4)
    calls = []

    def put(rows):
        calls.append(1)
        s.put(rows.withColumn("text", F.when(F.col("text") == "bad", F.raise_error(F.lit("poisoned"))).otherwise(F.col("text"))))

    rows = [(f"k{i}", "p", 1, "bad" if i in (3, 17) else "ok") for i in range(24)]
    left = put_or_report(spark.createDataFrame(rows, SCHEMA), "id", put, tries=1)
    assert [k for k, _ in left] == ["k17", "k3"] and all("poisoned" in e for _, e in left)
    assert {r.id for r in s.read().collect()} == {f"k{i}" for i in range(24)} - {"k3", "k17"} and len(calls) < 40
    assert put_or_report(spark.createDataFrame(rows[:0], SCHEMA), "id", put) == []
