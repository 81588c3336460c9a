"""Pairs of equal keys against nested loops, and what they take when written."""

from pyspark.sql import functions as F

from evidra.operators import matches as M


def test_pairs(spark, monkeypatch):
    """Keys of one side only, nulls, values that come twice; keys of several bundles and shares."""
    left = [(k, a) for k, n in (("a", 40), ("b", 1), ("c", 3)) for a in range(n)] + [("a", None), ("a", 3), (None, 1)]
    right = [(k, b) for k, n in (("a", 17), ("b", 5), ("d", 3)) for b in range(n)] + [("b", None), (None, 1)]
    want = sorted((str(a), str(b)) for k, a in left for x, b in right if k is not None and k == x)
    for sizes in ((256, 64), (4, 2)):
        for name, n in zip(("BUNDLE", "SHARE"), sizes):
            monkeypatch.setattr(M, name, n)
        got = M.pairs_by_key(spark.createDataFrame(left, "key string, x long"), spark.createDataFrame(right, "key string, y long"))
        assert got.columns == ["x", "y"] and sorted((str(r.x), str(r.y)) for r in got.collect()) == want


def test_written_pairs_are_small(spark, tmp_path):
    """Six million pairs of one key take less than a third of the plain join's files."""
    left = spark.range(2003).select(F.lit("k").alias("key"), (F.col("id") * 1_000_003).alias("a"))
    right = spark.range(3001).select(F.lit("k").alias("key"), (F.col("id") * 1_000_003).alias("b"))
    size = {}
    for name, df in (("pairs", M.pairs_by_key(left, right)), ("join", left.join(right, "key").select("a", "b"))):
        df.write.parquet(f"{tmp_path}/{name}")
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    back = spark.read.parquet(f"{tmp_path}/pairs")
    assert back.count() == 2003 * 3001 and back.select(F.count_distinct("a"), F.count_distinct("b")).first() == (2003, 3001)
    assert size["pairs"] * 3 < size["join"]
