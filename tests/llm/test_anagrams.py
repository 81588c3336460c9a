import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from evidra.llm import sql
from evidra.llm.anagrams import LETTERS, op12_spelling_variants, variants, word_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    """Words of (doc_id, text) rows, by the contract."""
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(n):
    by = {w: [] for w in n}
    for a, b in itertools.combinations(sorted(n), 2):
        if near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), form[w] and n[form[w]]))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("crowd", [2_000, 3, 0])
def test_against_all_pairs(spark, crowd):
    """Few letters, so that many words share a key; also with keys divided, and with words too long to compare as text."""
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.choice((7, 8, 8, 9)))): r.choice((2, 3, 30, 400, 5_000)) for _ in range(500)}
    long = "".join(r.choice("ab") for _ in range(64))
    for i in (0, 10, 11, 63):
        words |= {long[:i] + long[i + 1 :]: 2 + i, long[:i] + "c" + long[i:]: 900, long[:i] + "ÿ" + long[i + 1 :]: 7}
    words |= {"a" * 70: 5, "a" * 71: 60, "a" * 30 + "b" + "a" * 40: 5, long: 40}
    got = variants(spark.createDataFrame(list(words.items()), "word string, n long"), crowd)
    assert got.count() == len(words) and rows(got) == brute(words)


def test_odd_texts(spark):
    docs = [(1, "Thorough thorough THOROUGH thorougÀ x" * 20), (2, None), (3, ""), (None, "thorough th×rough"), (4, "Thorough, thorôugh-thorôughĀabcdefg abcdefg"), (4, "abcdefghŸabcdefg")]
    docs += [(i, "wonderful wonderfull wonderfuls wander " * 3) for i in range(5, 90)] + [(200, "z" * 40_000 + " " + "z" * 40_000)]
    docs += docs[:2]
    df = spark.createDataFrame([(*d, 3, "mine") for d in docs], "doc_id long, text string, n int, word string")
    n = counted(docs)
    assert {r.word: r.n for r in word_counts(df, "doc_id", "text").collect()} == n
    assert rows(variants(word_counts(df, "doc_id", "text"))) == brute(n)
    assert variants(word_counts(df.limit(0), "doc_id", "text")).count() == 0 and LETTERS == 7


def test_query_and_sql(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op12_spelling_variants(spark, sf_dir)
    n = counted(docs)
    assert {r.word: r.n for r in got.collect()} == n
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(sql.ORACLES["op12_spelling_variants"])
    assert [c[0] for c in want.description] == got.columns
    assert rows(got) == set(want.fetchall()) and got.count() == len(n)
