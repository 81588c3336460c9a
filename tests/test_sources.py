import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from evidra.sources import files
from evidra.sources.store import Versions, delete, upsert


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_records(spark, tmp_path):
    schema = "id string, n long"
    array = put(tmp_path, "a.json", ' [{"id": "x", "n": 1},\n {"id": "y"}]')
    lines = put(tmp_path, "b.jsonl", '{"id": "x", "n": 1}\n{"id": "y"}\n')
    assert sorted(map(tuple, files.read_records(spark, array, schema).collect())) == sorted(map(tuple, files.read_records(spark, lines, schema).collect())) == [("x", 1), ("y", None)]
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED|oops"):
        files.read_records(spark, put(tmp_path, "c.jsonl", '{"id": "x"}\n{oops\n'), schema).collect()


def test_ids(spark, tmp_path):
    for name, text in (("a.txt", "# note\nx\n\ny\nx\n"), ("a.json", '["x", "y"]'), ("a.jsonl", '"x"\n{"id": "y", "n": 2}\n')):
        assert sorted(r.id for r in files.read_ids(spark, put(tmp_path, name, text)).collect()) == ["x", "y"]


def test_annotations(spark, tmp_path):
    cols = files.ANNOTATION_COLUMNS
    row = [" 1 ", "dev", 'says "hi", twice\nand on'.replace('"', '""'), *["x"] * (len(cols) - 3)]
    df = files.read_annotations(spark, put(tmp_path, "a.csv", ",".join(cols) + "\n" + ",".join(f'"{c}"' for c in row) + "\n"))
    (r,) = df.collect()
    assert r.id == "1" and r.summary == 'says "hi", twice\nand on'
    files.write_annotations(df, str(tmp_path / "out"))
    assert files.read_annotations(spark, str(tmp_path / "out")).collect() == [r]
    with pytest.raises(ValueError, match="split"):
        files.read_annotations(spark, put(tmp_path, "b.csv", "id\n1\n"))


def test_unique(spark, tmp_path):
    assert len(files.read_unique(spark, put(tmp_path, "a.csv", "id,v\n1,a\n2,b\n")).collect()) == 2
    with pytest.raises(PySparkException, match="duplicate id"):
        files.read_unique(spark, put(tmp_path, "b.csv", "id,v\n1,a\n1,b\n")).collect()


def test_runs(spark):
    paths = [f"s/c/run_0{i}/{f}" for i in (1, 2) for f in files.RUN_FILES if (i, f) != (2, "scores.csv")] + ["s/c/other/scores.csv"]
    assert [tuple(r) for r in files.complete_runs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()] == [("s/c/run_01", 1)]


def test_store(spark, tmp_path):
    schema = "id string, parent_id string, v int"
    old = spark.createDataFrame([("a", "p", 1), ("b", "q", 1)], schema)
    new = spark.createDataFrame([("a", "p", 2), ("c", "r", 0), ("c", "r", 0)], schema)
    up = upsert(old, new, "id", "v")
    assert sorted(map(tuple, up.collect())) == [("a", "p", 2), ("b", "q", 1), ("c", "r", 0)]
    assert sorted(r.id for r in delete(up, spark.createDataFrame([("p",), ("b",)], "x string")).collect()) == ["c"]
    at = Versions(spark, f"file://{tmp_path}/v")
    assert at.read() is None and at.current() is None
    at.write(old, 0)
    at.write(up, 10)
    assert at.current()[0] == 10 and at.read().count() == 3
