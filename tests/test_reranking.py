"""The reranker on made candidates: ranks, ties, gates, freshness."""

from evidra.operators import reranking as K

FIELDS = ("system_names", "partition_names", "service_names", "module_names", "software_versions", "toolchain_versions", "software_names", "scope_family_names")
CANDIDATE = "query_id string, id string, source_ranks map<string,int>, best_score double, source_authority string, validity_status string, freshness_hint string, " + ", ".join(f"{f} array<string>" for f in FIELDS)
ASKED = "query_id string, " + ", ".join(f"{f} array<string>" for f in FIELDS)


def candidate(i, ranks=None, authority=None, status=None, date=None, best=1.0, **sets):
    return ("q", i, ranks or {"docs": 1}, best, authority, status, date, *[sets.get(f) for f in FIELDS])


def ran(spark, rows, asked=None, weights=None, **more):
    q = spark.createDataFrame([("q", *[(asked or {}).get(f) for f in FIELDS])] if asked is not None else [], ASKED)
    out = K.validity_rerank(spark.createDataFrame(rows, CANDIDATE), q, weights or dict.fromkeys(K.FEATURES, 0.1), {"local": 1.0, "forum": 0.25}, {"current": 1.0, "eol": -1.0}, **more)
    return {r.id: r for r in out.collect()}


def test_merge_and_rrf(spark):
    hits = spark.createDataFrame([("q", "a", "x", 1, 0.9), ("q", "a", "y", 3, 0.5), ("q", "a", "y", 2, 0.4), ("q", "b", "y", 1, 0.8)], "query_id string, id string, source string, rank int, score double")
    got = {r.id: r for r in K.rrf_rerank(K.merged(hits), {"y": 2.0}).collect()}
    assert got["a"].source_ranks == {"x": 1, "y": 2} and got["a"].sources == ["x", "y"] and got["a"].best_score == 0.9
    assert abs(got["a"].rrf - (1 / 61 + 2 / 62)) < 1e-12 and abs(got["b"].rrf - 2 / 61) < 1e-12
    assert (got["a"].place, got["b"].place) == (1, 2)


def test_without_constraints(spark):
    got = ran(spark, [candidate("a", {"docs": 1}), candidate("b", {"docs": 2}, " Local ", "Current"), candidate("c", {"docs": 3}, "", "eol")])
    assert [got[i].semantic_base for i in "ac"] == [1.0, 0.0] and (got["b"].authority, got["b"].status, got["c"].status) == (1.0, 1.0, -1.0)
    assert all((r.scope, r.software, r.version, r.scope_family) == (0.0,) * 4 for r in got.values())
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1].place)] == ["a", "b", "c"]


def test_ties_go_by_base_rank(spark):
    got = ran(spark, [candidate(i) for i in "abc"])
    assert all(r.semantic_base == 1.0 for r in got.values()) and [got[i].base_rank for i in "cba"] == [1, 2, 3] == [got[i].place for i in "cba"]


def test_matches_and_means(spark):
    got = ran(spark, [candidate("a", system_names=["One"], partition_names=["p"], software_versions=["1.2"]), candidate("b")], {"system_names": ["one "], "partition_names": ["other"], "module_names": ["m"], "software_versions": ["1.2"]})
    assert (got["a"].scope, got["a"].version) == (0.0, 0.5) and (got["b"].scope, got["b"].version) == (0.0, 0.0)


def test_gates(spark):
    family = {"scope_family_names": ["icelake"]}
    rows = [candidate("none", **family), candidate("soft", software_names=["Gcc"], **family), candidate("other", software_names=["fftw"], **family), candidate("special", software_names=["gcc"], partition_names=["icelake-himem"], **family), candidate("else", software_names=["gcc"], scope_family_names=["pvc"])]
    got = ran(spark, rows, {"software_names": ["gcc"], **family})
    assert {i: (r.scope_family, r.gate) for i, r in got.items()} == {"none": (0.0, "blocked_no_software_match"), "soft": (1.0, "applied"), "other": (0.0, "blocked_no_software_match"), "special": (0.0, "blocked_specialized_variant"), "else": (-1.0, "applied")}
    exact = ran(spark, rows, {"software_names": ["gcc"], "partition_names": ["x"], **family})
    assert (exact["special"].scope_family, exact["special"].gate) == (1.0, "applied")
    named = ran(spark, rows, {"software_names": ["gcc"], "module_names": ["icelake-himem/1"], **family})
    assert named["special"].gate == "applied"
    free = ran(spark, rows, family)
    assert all(r.gate == "applied" for r in free.values())


def test_freshness_within_authority(spark):
    rows = [candidate("a", authority="local", date="2024-01-03"), candidate("b", authority="Local", date="2024-01-02T00:00:00Z"), candidate("c", authority="local", date="2024-01-01"), candidate("d", authority="forum", date="2020-01-01"), candidate("e", authority="forum", date="soon"), candidate("f")]
    got = ran(spark, rows)
    assert [got[i].freshness for i in "abcdef"] == [1.0, 0.5, 0.0, 1.0, 0.0, 0.0]
