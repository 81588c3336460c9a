import itertools

import numpy as np
import pytest

from evidra.operators import splits as S


def features(rows):
    values = sorted({(j, v) for r in rows for j, v in enumerate(r)})
    return np.array([[int(r[j] == v) for j, v in values] for r in rows])


@pytest.mark.parametrize("seed", range(12))
def test_as_good_as_all_choices(seed):
    r = np.random.default_rng(seed)
    rows = [tuple(r.integers(0, k) for k in (2, 3, 2, 4)) for _ in range(12)]
    kinds = sorted(set(rows))
    has, held = features(kinds), np.array([rows.count(k) for k in kinds])
    size = int(r.integers(2, 7))
    each = features(rows)
    goal, totals = S.targets(each.sum(0), size, 12), each.sum(0)
    best = min(float(S.score(each[list(c)].sum(0), goal, totals)) for c in itertools.combinations(range(12), size))
    tries = [S.searched(has, held, size, 42 + i) for i in range(8)]
    assert min(s for s, _ in tries) <= best + 1e-9
    for s, taken in tries:
        assert taken.sum() == size and (taken <= held).all() and (taken >= 0).all() and abs(s - S.score(taken @ has, goal, totals)) < 1e-9


def test_sizes():
    assert S.resolved_size(5, fraction=0.5) == 2 and S.resolved_size(7, fraction=0.5) == 4 and S.resolved_size(9, size=3) == 3
    for bad in ((1, 1, None), (5, 2, 0.5), (5, None, None), (5, None, 1.0), (5, 5, None), (5, 0, None), (5, None, 0.01)):
        with pytest.raises(ValueError):
            S.resolved_size(*bad)


def test_split(spark):
    rows = [(i, "abc"[i % 3], None if i % 7 == 0 else " x " if i % 2 else "y", i % 5 == 0, "kept") for i in range(600)] + [(1000 + i, "hot", "y", True, "kept") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c boolean, split_note string")
    got = S.multilabel_split(df, "id", ["a", "b", "c"], fraction=0.2, seed=7)
    out = got.collect()
    assert got.columns == [*df.columns, "split"] and len(out) == 1000 and sum(r.split == "test" for r in out) == 200
    for column in ("a", "b", "c"):
        for value in {r[column] for r in out}:
            held = [r.split for r in out if r[column] == value]
            assert abs(held.count("test") - len(held) / 5) <= 2
    again = S.multilabel_split(df.repartition(7), "id", ["a", "b", "c"], fraction=0.2, seed=7).collect()
    assert {(r.id, r.split) for r in out} == {(r.id, r.split) for r in again}
    with pytest.raises(ValueError):
        S.multilabel_split(df.limit(1), "id", ["a"], fraction=0.2)
