import random

import numpy as np

import evidra.llm.jaccard as J
from evidra.llm.shingles import shingle_set


def brute(texts):
    """component of each id, by all pairs of sets of strings."""
    sets = {}
    for d, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
        sets.setdefault(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    where = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    seen = set()
    for x in where.values():
        for i, a in enumerate(x):
            for b in x[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        p, q = root(a), root(b)
                        up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 60, 100, 333, 2000]:
        for _ in range(12 if n < 400 else 3):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 4 + 1))
            keep = a[rng.permutation(n)[: n - drop]]
            add = 0
            while J.linked(len(keep), n, len(keep) + add + 1):
                add += 1
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(rng.integers(0, add + 1)), dtype=np.uint64)]))
            if not J.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                continue
            for frequent in (np.zeros(0, np.uint64), np.sort(a[: n // 2]), a):
                assert len(np.intersect1d(J.signatures(a, frequent), J.signatures(b, frequent)))
            ca, cb = (np.frombuffer(J.cells(x), np.uint8)[None] for x in (a, b))
            assert J.possible(np.array([len(a)]), np.array([len(b)]), ca, cb)[0].all()


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    line = [word() for _ in range(12)]
    texts, d = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 15])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, len(t) // 50 + 1])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t + line
            texts.append((d, rng.choice([" ", "\n", "\t "]).join(t) if rng.random() < 0.8 else " ".join(t).upper()))
            d += 1
    return texts + [(d, None), (d + 1, ""), (d + 2, " \n"), (d + 3, "é É"), (d + 4, "É é"), (d + 5, "É é")]


def test_against_all_pairs(spark, monkeypatch):
    texts = made()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()} == want


def test_large_groups_are_completed(spark, monkeypatch):
    """Two families in one group whose centres don't link with all: pairs across components are searched."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for d in range(60):
        t = list(base)
        t[rng.randrange(60)] = f"x{rng.randrange(9)}"
        if d % 2:
            t[rng.randrange(60)] = f"y{rng.randrange(4)}"
        texts.append((d, " ".join(t)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()} == brute(texts)


def test_a_large_family(spark, monkeypatch):
    """1,500 near copies that mostly lie too far from the centres: whole result, and fewer links than sets in the second search."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(48)]
    texts = []
    for d in range(1500):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            t[rng.randrange(48)] = f"x{rng.randrange(40)}"
        texts.append((d, " ".join(t)))
    given = []
    real = J._across
    monkeypatch.setattr(J, "_across", lambda *a: given.append(out := real(*a)) or out)
    monkeypatch.setattr(J, "BLOCK", 200)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()}
    assert got == {d: c for d, (_, c) in brute(texts).items()}
    assert 0 < given[0].count() < 1500


def test_null_keys_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", "x", 1), (4, "a b c d e f", "y", 2), (None, "q r s", "z", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string, component_id int")
    got = sorted(map(tuple, J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)], key=str)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.op5_jaccard(spark, sf_dir).collect()} == brute(texts)


def test_odd_tables(spark):
    df = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 1), (3, "A b  c d\te f", 2), (1, None, 0)], "doc_id long, text string, n int")
    rows = sorted(tuple(r) for r in J.jaccard_components(df).collect())
    assert rows == [(1, 0, 1), (3, 2, 3), (7, 2, 3), (7, 2, 3)]
    assert J.jaccard_components(df.limit(0)).count() == 0
    assert len(shingle_set(b"one two")) == 1


def test_counts_tell_long_sets_apart():
    """Long unlike sets of a size are pruned by their counts, before their texts are moved; linked ones are not."""
    rng = np.random.default_rng(5)
    for n, m in ((5000, 5000), (8000, 8400), (20_000, 19_000)):
        a, b = (np.unique(rng.integers(0, 1 << 64, k, dtype=np.uint64)) for k in (n, m))
        ca, cb = (np.frombuffer(J.cells(x), np.uint8)[None] for x in (a, b))
        assert not J.possible(np.array([n]), np.array([m]), ca, cb)[0].any()
        near = np.unique(np.concatenate([a[rng.permutation(n)[: int(0.9 * n)]], b[: n // 40]]))
        assert J.linked(len(np.intersect1d(a, near)), n, len(near))
        assert J.possible(np.array([n]), np.array([len(near)]), ca, np.frombuffer(J.cells(near), np.uint8)[None])[0].all()


def test_whole_sets_are_moved_only_where_counts_leave_room(spark, monkeypatch):
    """Documents that share a passage but are else unlike meet in a group; none of their sets is moved to be searched."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    texts = [(d, " ".join([f"w{rng.randrange(10**6)}" for _ in range(60)] + passage)) for d in range(40)]
    moved = []
    real = J._sets
    monkeypatch.setattr(J, "_sets", lambda src, ids: moved.append(ids.count()) or real(src, ids))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()} == brute(texts)
    assert moved == [0]
