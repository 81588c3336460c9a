import pytest
from pyspark.sql import functions as F

from evidra.operators import constraints as C

SCHEMA = "entity_id string, entity_type string, canonical_name string, aliases array<string>, known_versions array<string>"
LAMMPS = ("software-lammps", "software", "LAMMPS", ["LAMMPS", "lammps"], ["2024.4", "2025.1"])
BARE = ("software-lammps", "software", "LAMMPS", ["LAMMPS", "lammps"], None)
GROMACS = ("software-gromacs", "software", "GROMACS", ["GROMACS", "gromacs"], ["2024.4"])
LAKE = [("partition-cclake", "partition", "cclake", ["cclake"], []), ("system-cclake", "system", "Cascade Lake Nodes", ["cclake", "cascade lake nodes"], [])]
TOOLS = [GROMACS, ("module-gromacs", "module", "gromacs/2024.4", ["gromacs/2024.4"], ["2024.4"]), ("toolchain-cuda", "toolchain", "cuda/12.1", ["cuda/12.1"], ["12.1"]), ("module-base", "module", "rhel8/cclake/base", ["rhel8/cclake/base"], [])]
TWICE = [("software-fftw", "software", "FFTW", ["fftw"], ["3.3.10"]), ("module-fftw", "module", "fftw/3.3.10", ["fftw"], ["3.3.10"]), ("toolchain-fftw", "toolchain", "fftw-tools", ["fftw"], ["3.3.10"])]
SERVICE = [("service-od", "service", "Open OnDemand", ["ondemand", "c+\\E"], [])]

CASES = [
    ("How do I compile LAMMPS on CSD3?", [LAMMPS], {"software_names": ["LAMMPS"], "query_type": "general_how_to"}),
    ("Can I use cclake?", LAKE, {"scope_family_names": ["cclake"], "scope_required": True, "query_type": "local_operational"}),
    ("sbatch -p cclake run_job.sh", LAKE, {"partition_names": ["cclake"], "scope_family_names": ["cclake"], "scope_required": True, "query_type": "local_operational"}),
    ("How do I run GROMACS 2024.4 on cclake?", [GROMACS, *LAKE], {"software_names": ["GROMACS"], "software_versions": ["2024.4"], "scope_family_names": ["cclake"], "scope_required": True, "version_sensitive_guess": True, "query_type": "software_version"}),
    ("How do I compile LAMMPS 2024.4?", [LAMMPS], {"software_names": ["LAMMPS"], "software_versions": ["2024.4"], "version_sensitive_guess": True, "query_type": "software_version"}),
    ("What documentation exists on cclake?", LAKE, {}),
    ("How do I compile LAMMPS 2024.4?", [BARE], {"software_names": ["LAMMPS"], "version_sensitive_guess": True, "query_type": "software_version"}),
    ("Which is the latest LAMMPS?", [BARE], {"software_names": ["LAMMPS"], "version_sensitive_guess": True, "query_type": "software_version"}),
    ("module load rhel8/cclake/base gromacs/2024.4 cuda/12.1", TOOLS, {"software_names": ["GROMACS"], "scope_family_names": ["cclake"], "module_names": ["gromacs/2024.4", "rhel8/cclake/base"], "toolchain_names": ["cuda/12.1"], "software_versions": ["2024.4"], "toolchain_versions": ["12.1"], "scope_required": True, "version_sensitive_guess": True, "query_type": "software_version"}),
    ("Can you help me?", [LAMMPS], {}),
    ("How do I install GROMACS?", [GROMACS, *LAKE], {"software_names": ["GROMACS"], "query_type": "general_how_to"}),
    ("Which cclake nodes should I use?", LAKE, {"system_names": ["Cascade Lake Nodes"], "scope_family_names": ["cclake"], "scope_required": True, "query_type": "local_operational"}),
    ("My quota is full", LAKE, {"query_type": "local_operational"}),
    ("Where is FFTW?", TWICE, {"software_names": ["FFTW"], "query_type": "general_how_to"}),
    ("Which modules give fftw 3.3.10?", TWICE, {"module_names": ["fftw/3.3.10"], "toolchain_names": ["fftw-tools"], "toolchain_versions": ["3.3.10"], "version_sensitive_guess": True, "query_type": "software_version"}),
    ("xfftw fftwx fftw1 are others", TWICE, {}),
    ("is C+\\E an OnDemand app, é?", SERVICE, {"service_names": ["Open OnDemand"], "scope_required": True, "query_type": "local_operational"}),
    ("\U0001f600 " * 20 + "jobs on the cclake", LAKE, {"scope_family_names": ["cclake"], "scope_required": True, "query_type": "local_operational"}),
    ("run this first, then wait a good while; and at last cclake", LAKE, {}),
    ("   ", LAKE, {}),
    (None, LAKE, {}),
]


def test_cases(spark):
    """Queries of one registry run together."""
    lists = {*C.NAMES.values(), *C.VERSIONS.values(), "scope_family_names"}
    for registry in {str(e): e for _, e, _ in CASES}.values():
        asked = {i: (text, want) for i, (text, e, want) in enumerate(CASES) if e == registry}
        got = C.query_constraints(spark.createDataFrame([(i, t) for i, (t, _) in asked.items()], "query_id int, text string"), spark.createDataFrame(registry, SCHEMA))
        rows = {r.query_id: r.asDict() for r in got.collect()}
        for i, (text, want) in asked.items():
            assert rows[i] == {"query_id": i} | {c: want.get(c, [] if c in lists else None) for c in C.COLUMNS}, text


def test_indexable(spark):
    names = {"ab": False, "abc": True, "a1": True, "a": False, "1": False, "-": True, "a/b": True, "..": False, "a.b": True, "é.": False, "éà": False, "ÉÀÇ": True, "": False}
    df = spark.createDataFrame([(k,) for k in names], "a string")
    assert {r.a: r.x for r in df.select("a", C.indexable(F.col("a")).alias("x")).collect()} == names


@pytest.mark.parametrize("many", [3000])
def test_many_aliases(spark, many):
    """A registry of thousands of names, of which one stands in a query, is joined by token and not sent pair by pair."""
    e = spark.range(many).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit("software").alias("entity_type"), F.concat(F.lit("name"), "id").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("known_versions"))
    q = spark.createDataFrame([(1, "name17 and NAME2999, not name3000 or name1x")], "query_id int, text string")
    assert C.query_constraints(q, e).first().software_names == ["name17", "name2999"]


def test_a_text_is_read_once(spark):
    """Thousands of queries with three texts: tokens are made of three, and queries may share an id or have none."""
    texts = ["How do I run GROMACS 2024.4 on cclake?", "sbatch -p cclake run_job.sh", "nothing here"]
    q = spark.range(3000).select(F.when(F.col("id") > 5, F.col("id")).alias("query_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    q = q.union(q.where("query_id = 7"))
    df = C.query_constraints(q, spark.createDataFrame([GROMACS, *LAKE], SCHEMA))
    got = df.groupBy("query_type", "software_names", "partition_names", "scope_family_names").count().collect()
    assert {(r.query_type, *r.software_names, *r.partition_names, *r.scope_family_names): r["count"] for r in got} == {("software_version", "GROMACS", "cclake"): 1000, ("local_operational", "cclake", "cclake"): 1001, (None,): 1000}
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == "Generate":
            most = max(most, p.metrics().apply("numOutputRows").value())
        p = p.plan() if "QueryStage" in p.nodeName() else p
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert 0 < most < 100
