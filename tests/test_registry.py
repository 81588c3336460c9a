from evidra.operators import registry as R


def cand(scope, kind, name, aliases=(), versions=(), status="unknown", doc="d1", path=("A",), method="page", text="e"):
    return (scope, kind, name, list(aliases) or None, list(versions) or None, status, doc, f"title {doc}", list(path), text, method)


ROWS = [
    cand("local_official_services", "service", "Open OnDemand", ["OnDemand", "ood"], ["1.8"], "current", "d2"),
    cand("local_official", "service", "open-ondemand", [" ood ", ""], ["2.0", "1.8"], "unknown", "d9", ("B", "C"), "code"),
    cand("local_official", "partition", "cclake", ["cclake", "lake"], (), "current", "d3"),
    cand("local_official", "partition", "cclake", ["cclake"], (), "legacy", "d1"),
    cand("local_official", "partition", "icelake", ["icelake", "Lake!"], (), "unknown", "d4"),
    cand("external_official", "service", "open ondemand", ["x"], (), "eol", "d5"),
    cand("forum", "software", "GROMACS", ["gromacs"], ["2024.4"], "unknown", "d6", (), "page"),
    cand("forum", "software", "GROMACS", ["gromacs"], ["2024.4"], "unknown", "d6", (), "page"),
]


def test_merge(spark):
    r = R.merged(spark.createDataFrame(ROWS, R.CANDIDATE))
    e = {(x.source_scope, x.canonical_name): x for x in r.entities.collect()}
    assert set(e) == {("local_official", "open-ondemand"), ("local_official", "cclake"), ("local_official", "icelake"), ("external_official", "open ondemand"), ("forum", "GROMACS")}
    ood = e["local_official", "open-ondemand"]
    assert (ood.aliases, ood.known_versions, ood.status, ood.doc_id, ood.heading_path, ood.extraction_method, ood.review_state) == (["OnDemand", "ood"], ["1.8", "2.0"], "current", "d9", ["B", "C"], "merged", "auto_verified")
    lake = e["local_official", "cclake"]
    assert (lake.status, lake.doc_id, lake.review_state, e["local_official", "icelake"].review_state) == ("unknown", "d1", "needs_review", "needs_review")
    assert e["forum", "GROMACS"].extraction_method == "page" and len({x.entity_id for x in e.values()}) == 5
    q = {x.reason: x for x in r.reviews.collect()}
    c, a = q["conflicting_status"], q["alias_ambiguity"]
    assert (c.canonical_name, c.candidate_count, c.status_values, c.doc_ids) == ("cclake", 2, ["current", "legacy"], ["d1", "d3"])
    assert (a.canonical_name, a.candidate_count, a.status_values, a.aliases, a.doc_ids) == ("cclake / icelake", 2, [], ["Lake!", "cclake", "icelake", "lake"], ["d1", "d4"]) and "'lake'" in a.notes
    assert sorted((x.doc_id, x.evidence_text) for x in r.evidence.where(f"entity_id = '{ood.entity_id}'").collect()) == [("d2", "e"), ("d9", "e")] and r.evidence.count() == 7
    s = {(x.measure, x.value): x.n for x in R.summary(r).collect()}
    assert s["entity_count", ""] == 5 and s["review_count", ""] == 2 and s["counts_by_entity_type", "partition"] == 2 and s["counts_by_review_reason", "alias_ambiguity"] == 1


def test_registries_and_files(spark, tmp_path):
    one, two = (R.merged(spark.createDataFrame(rows, R.CANDIDATE)) for rows in (ROWS[:3], [ROWS[4], cand("local_official", "partition", "CCLAKE", ["cc"], ["3"], "eol", "d0"), ROWS[5]]))
    both = R.across(one, two)
    e = {(x.source_scope, x.canonical_name): x for x in both.entities.collect()}
    lake = e["local_official", "CCLAKE"]
    assert (lake.aliases, lake.known_versions, lake.status, lake.review_state, lake.doc_id) == (["cc", "cclake", "lake"], ["3"], "unknown", "needs_review", "d0") and len(e) == 4
    assert sorted(x.doc_id for x in both.evidence.where(f"entity_id = '{lake.entity_id}'").collect()) == ["d0", "d3"]
    R.write_registry(both, f"{tmp_path}/r", {"source_scope": "multi_scope", "b": 1, "a": 2})
    back, build, docs = R.read_registry(spark, f"{tmp_path}/r")
    assert list(build) == sorted(build) and back.entities.count() == 4 and {(d.url, d.source_scope) for d in docs.collect()} == {(f"d{i}", "multi_scope") for i in (0, 2, 3, 4, 5, 9)}
    R.write_registry(both, f"{tmp_path}/r", {}, spark.createDataFrame([("u", "s")], "url string, source_scope string"))
    assert R.read_registry(spark, f"{tmp_path}/r")[2].collect() == [("u", "s")]
    R.write_reviews(both.reviews, f"{tmp_path}/q")
    lines = spark.read.csv(f"{tmp_path}/q", header=True).collect()
    assert {r.status_values for r in lines} == {None, "current|eol"} and all(r.doc_ids for r in lines)


def test_empty(spark):
    r = R.merged(spark.createDataFrame([], R.CANDIDATE))
    assert r.entities.count() == r.reviews.count() == r.evidence.count() == 0
