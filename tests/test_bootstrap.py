import random
import statistics

from evidra.operators.bootstrap import bootstrap_ci, paired


def test_interval(spark):
    rng = random.Random(1)
    rows = [(c, i, rng.gauss(m, 1.0)) for c, m in (("a", 0.0), ("b", 5.0)) for i in range(80)] + [("a", 900, None)]
    df = spark.createDataFrame(rows, "condition string, item long, value double")
    got = {r.condition: r for r in bootstrap_ci(df, resamples=2000).collect()}
    for c in "ab":
        v = [x for k, _, x in rows if k == c and x is not None]
        half = 1.96 * statistics.pstdev(v) / len(v) ** 0.5
        r = got[c]
        assert r.n == 80 and abs(r.mean - statistics.mean(v)) < 1e-5
        assert abs(r.ci_low - (r.mean - half)) < 0.05 and abs(r.ci_high - (r.mean + half)) < 0.05
    assert got == {r.condition: r for r in bootstrap_ci(df.repartition(3), resamples=2000).collect()}
    (d,) = bootstrap_ci(paired(df), resamples=500).collect()
    assert d.condition == "a - b" and d.n == 80 and d.ci_high < 0


def test_one_value_and_none(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "condition string, item long, value double")
    (r,) = bootstrap_ci(df, resamples=50).collect()
    assert (r.mean, r.ci_low, r.ci_high) == (2.0, 2.0, 2.0)
    assert not bootstrap_ci(df.limit(0), resamples=50).collect()
