import duckdb
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from evidra.llm import sql  # noqa: E402
from evidra.llm.common import table  # noqa: E402
from evidra.llm.jaccard import op5_jaccard  # noqa: E402
from evidra.llm.secrets import BASE, MORE, scanner  # noqa: E402
from evidra.llm.warc import op7_warc  # noqa: E402
from tests.llm.test_jaccard import brute  # noqa: E402
from tests.llm.test_packing import check  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = pipeline.quality(spark, docs, sf_dir)
    assert good.columns == columns
    kept = {r.doc_id: r.text for r in good.collect()}
    of = lambda q: [d in kept for d, x in labels.items() if x == q]
    assert sum(of(1)) >= 0.95 * len(of(1)) and sum(of(0)) <= 0.2 * len(of(0))  # some 50 labels to learn from here
    one = pipeline.near_duplicates(spark, good, sf_dir)
    left = {r.doc_id: r.text for r in one.collect()}
    want = {c for _, c in brute(sorted(kept.items())).values()}
    assert set(left) == want and one.columns == columns
    clean = pipeline.secrets(spark, one, sf_dir)
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(rows) == want
    s = scanner(BASE + MORE)
    for d, r in rows.items():
        assert not s.spans(r.text.encode()) and r.n_chars == len(r.text)
        assert r.text == before[d].text or s.spans(before[d].text.encode())
    out = pipeline.run(spark, sf_dir).collect()
    check(out, {d: r.text for d, r in rows.items()})


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, columns named like the stages' own, and an empty table, through every stage."""
    text = "The quick brown fox jumps over the lazy dog and runs far away, password=abcdef12."
    rows = [(1, text, "x", 9, "a", 5), (1, text, "x", 9, "a", 5), (2, text.upper(), "y", 8, "b", 6), (3, None, None, None, None, None), (4, "", "z", 7, "c", 0), (None, text, "w", 6, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, class string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and docs.schema == df.schema
        if name == "quality":
            assert sorted(map(str, docs.collect())) == sorted(map(str, df.collect()))
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "1", "3", "4", "None"]
    got = {(r.doc_id, r.text, r.score, r.n_chars) for r in docs.collect()}
    clean = text.replace("password=abcdef12.", "[ASSIGN]")
    assert got == {(1, clean, "x", len(clean)), (3, None, None, None), (4, "", "z", 0), (None, clean, "w", len(clean))}
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "3", "4", "None"] and all(len(r.ids) == r.length for r in out)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("name", "query"), [("op5_jaccard", op5_jaccard), ("op7_warc", op7_warc)])
def test_sql(spark, sf_dir, name, query):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r)) for r in query(spark, sf_dir).select(*columns).collect())
