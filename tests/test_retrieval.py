import math
import random
import re
from collections import Counter

import pytest

from evidra.operators import retrieval as R


def brute(docs, queries, k, cell, weight):
    words = lambda t: re.findall("[a-z0-9_]+", (t or "").lower())
    tf = {d: Counter(words(t)) for d, t in docs}
    n, avg = len(docs), max(1.0, sum(sum(c.values()) for c in tf.values()) / max(1, len(docs)))
    df = Counter(t for c in tf.values() for t in c)
    out = set()
    for q, text in queries:
        scores = {d: sum(m * weight(df[t], n) * cell(c[t], sum(c.values()), avg) for t, m in Counter(words(text)).items() if t in c) for d, c in tf.items() if set(words(text)) & set(c)}
        for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), str(x[0])))[:k]):
            out.add((q, d, round(s, 6), i + 1))
    return out


KINDS = {
    "bm25": (R.bm25, lambda tf, dl, avg: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)), lambda df, n: math.log(1 + (n - df + 0.5) / (df + 0.5))),
    "tfidf": (R.tfidf, lambda tf, dl, avg: tf, lambda df, n: (math.log((n + 1) / (df + 1)) + 1) ** 2),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("matrix", [1 << 24, 0])
def test_rankings(spark, kind, matrix, monkeypatch):
    """By blocks of few documents, and by the join that takes over where the queries are too many."""
    monkeypatch.setattr(R, "MATRIX", matrix)
    monkeypatch.setattr(R, "BLOCK", 1)
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(500, None), (501, "zz only"), (502, "A b"), (1000, "A b")]
    queries = [(1, "a b c a"), (2, "hh"), (3, "none here"), (4, None), (5, "zz A")]
    run, cell, weight = KINDS[kind]
    p = R.postings(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id int, text string"))
    got = {(x.query_id, x.doc_id, round(x.score, 6), x.rank) for x in run(p, 7).collect()}
    want = brute(docs, queries, 7, cell, weight)
    assert {(q, d, n) for q, d, _, n in got} == {(q, d, n) for q, d, _, n in want} and len(got) == len(want) == 21
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want)))


def test_no_rows(spark):
    docs, queries = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert R.bm25(R.postings(docs, queries)).count() == 0 and R.tfidf(R.postings(spark.createDataFrame([(1, "b")], docs.schema), queries)).count() == 0


def cosine_brute(vectors, queries, k):
    """By the sums that the rule states: NaN first, no score last, ties by id."""
    out = []
    for q, a in queries:
        rows = []
        for i, v in vectors:
            if i != q:
                score = None
                if v is not None and a is not None and len(v) == len(a) and None not in v and None not in a:
                    dot, norms = sum(x * y for x, y in zip(v, a)), math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(y * y for y in a))
                    score = round(dot / norms, 6) if norms and not math.isinf(norms) and not math.isnan(norms) else math.nan
                rows.append((2 if score is None else 0 if math.isnan(score) else 1, -score if score is not None and not math.isnan(score) else 0, i, score))
        out += [(q, i, str(s), n + 1) for n, (_, _, i, s) in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 8192, 1 << 20), (16, 3, 40)])
def test_dense_in_blocks(spark, sizes, monkeypatch):
    """Copies, vectors of no length, of infinite length, with nulls, of another length: no pairs are made by Spark, all are scored."""
    for name, n in zip(("SLICE", "ASKED", "PRODUCT"), sizes):
        monkeypatch.setattr(R, name, n)
    r = random.Random(6)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(90)] + [(i, [0.5, 0.25, 0.0, 0.0, 1.0]) for i in range(100, 130)]
    odd = [(200, [0.0] * 5), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [1.0, 2.0]), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [])]
    kind = "array<double>"
    for rows in (vectors, vectors[:4] + odd, vectors + odd):
        asked = [x for x in rows if x[0] % 10 == 0 or x[0] > 200]
        df, q = spark.createDataFrame(rows, f"id long, v {kind}"), spark.createDataFrame(asked, f"query_id long, q {kind}")
        got = R.dense(df, q, 7)
        assert sorted((x.query_id, x.id, str(x.score), x["rank"]) for x in got.collect()) == cosine_brute(rows, asked, 7)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "CoGroup" in plan
    assert R.dense(df.where("id < 0"), q).count() == R.dense(df, q.where("query_id < 0")).count() == 0
