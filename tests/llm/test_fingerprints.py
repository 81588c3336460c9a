import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from evidra.llm.fingerprints import Sketch, edited_by_next, fingerprints, op9_fingerprints, with_neighbours
from evidra.llm.shingles import word_hashes


def sketch(text):
    return Sketch.of(word_hashes(text.encode()))


@given(st.text(alphabet="ab \n\té", max_size=80))
def test_round_trip(text):
    s = sketch(text)
    r = Sketch.read(s.text())
    assert r.hashes.tolist() == s.hashes.tolist() and len(s.hashes) >= bool(text.split())
    assert s.resemblance(sketch(text)) == 1.0


def test_merge_and_containment():
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(400))
    assert sketch(b).containment(sketch(a)) == 1.0
    assert abs(sketch(a).containment(sketch(b)) - 0.1) < 0.03
    c = " ".join(f"w{i}" for i in range(396, 4000))
    assert sketch(b).merge(sketch(c)).hashes.tolist() == sketch(a).hashes.tolist()


@given(*[st.lists(st.sampled_from("abcdefgh"), max_size=14).map(" ".join)] * 3)
def test_merge_is_a_union(a, b, c):
    a, b, c = map(sketch, (a, b, c))
    same = lambda x, y: x.hashes.tolist() == y.hashes.tolist()
    assert same(a.merge(a), a) and same(a.merge(b), b.merge(a)) and same(a.merge(b).merge(c), a.merge(b.merge(c)))
    if not len(set(a.hashes.tolist()) & set(b.hashes.tolist())) and len(a.hashes):
        assert a.merge(a).resemblance(b.merge(b)) == 0.0


def exact(a, b):
    """Jaccard of five-word shingles, from sets of tuples."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", low(t))) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0, len(x | y)


def test_likeness_against_exact_jaccard(spark):
    docs = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect(), key=lambda r: -r.doc_id)
    rows = {r.doc_id: r for r in op9_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    errors = []
    for d, n in zip(docs, docs[1:] + docs[:1]):
        for got, other in ((rows[d.doc_id].near_edited, edited_by_next(d.text, n.text)), (rows[d.doc_id].near_next, n.text)):
            want, union = exact(d.text, other)
            errors.append(abs(got - want))
            assert errors[-1] <= 5 * (want * (1 - want) * 3 / union) ** 0.5 + 12 / union + (union < 60)
    assert sum(errors) / len(errors) < 0.03


def test_a_hot_key_is_parted(spark):
    df = spark.createDataFrame([(k, f"text {i} of {k}") for i in range(90) for k in (7, 7, 7, i + 100)], "doc_id long, text string")
    rows, parts = with_neighbours(df, "doc_id", "text")
    got = rows.where("not last").groupBy("part").count().collect()
    assert sum(r["count"] for r in got) == 360 and max(r["count"] for r in got) < 240


def test_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    rows = {r.doc_id: r for r in op9_fingerprints(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, n in zip(docs, docs[1:] + docs[:1]):
        r, e = rows[d.doc_id], edited_by_next(d.text, n.text)
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == sketch(d.text).text() and r.edited_fingerprint == sketch(e).text()
        assert r.near_edited == sketch(d.text).resemblance(sketch(e)) and r.near_next == sketch(d.text).resemblance(sketch(n.text))


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (5, None), (7, "one two three four five six seven eight nine"), (2, ""), (9, "x" * 10)]
    df = spark.createDataFrame([(*r, "mine", 1.5) for r in rows], "doc_id long, text string, fingerprint string, part double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op9_fingerprints(spark, str(tmp_path)).collect()}
    assert op9_fingerprints(spark, str(tmp_path)).count() == 5
    assert got[9].n_chars == 10 and got[2].near_next == 0.0 and got[5].near_edited == 1.0
    assert got[2].edited_sha256 == hashlib.sha256(b"").hexdigest()
    same = fingerprints(df).where("doc_id = 5").select("fingerprint").distinct().count()
    assert same == 1
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op9_fingerprints(spark, f"{tmp_path}/none").count() == 0
