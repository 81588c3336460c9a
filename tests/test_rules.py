"""Rules and values against plain Python on made texts and on the driver's."""

import re

from evidra.functions import rules as X
from evidra.functions import values as V
from evidra.plans.registry import QUERIES
from pyspark.sql import functions as F


def people(text):
    """(value, alias) by Python's own matcher: each kind's values by their first places."""
    out = {}
    for prefix in ("TICKET", "EMAIL", "PHONE", "USER", "IDENTIFIER"):
        values = []
        for kind, pattern in X.PERSONAL.items():
            if X.PREFIX.get(kind, kind) == prefix:
                values += [m[int(kind in X.GROUPED)].strip(" ") for m in re.finditer(pattern, text, re.ASCII)]
        fresh = [v for v in dict.fromkeys(values) if v not in out and not re.search(X.VISIBLE, v)]
        for i, v in enumerate(sorted(fresh, key=lambda v: (text.find(v), fresh.index(v)))):
            out[v] = f"{prefix}_{i + 1:03d}"
    return out


def cleared(text):
    aliases = people(text)
    for v in sorted(aliases, key=lambda v: (-len(v), v)):
        bare = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[A-Za-z0-9._-]+", v)
        text = re.sub(rf"(?<![A-Za-z0-9]){re.escape(v)}(?![A-Za-z0-9])" if bare else re.escape(v), aliases[v], text)
    return text


def test_personal_data(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts |= {-100: "HPC-12 and HPC-123 from Ann, ann.lee@example.org (also xann.lee@example.org), +44 1223 123456, /rds/user/al123/x, login: al123, account = q.w, at 1.2.3.4", -101: "", -102: "a$1 b\\E c@d.org"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", X.personal(F.col("text")).alias("p"), X.masked(F.col("text"), X.personal(F.col("text"))).alias("m")).collect()}
    for d, t in texts.items():
        assert {x.value: x.alias for x in got[d].p} == people(t)
        assert got[d].m == cleared(t)
    assert sum(bool(people(t)) for t in texts.values()) > 3
    assert got[-100].m.startswith("TICKET_001 and TICKET_002 from Ann, EMAIL_001 (also EMAIL_002), PHONE_001, /rds/user/USER_001/x, login: USER_001, account = USER_002, at IDENTIFIER_001")


FIXED = [
    ("login: bob then /home/al123/x", {"bob": "USER_001", "al123": "USER_002"}),
    ("HPC-12 of HPC-1, b@x.org, a@x.org and b@x.org", {"HPC-12": "TICKET_001", "HPC-1": "TICKET_002", "b@x.org": "EMAIL_001", "a@x.org": "EMAIL_002"}),
    ("user /home/USER_007/x and account USER_008, 1.2.3.4", {"1.2.3.4": "IDENTIFIER_001"}),
    ("account zed, /users/zed/y, login amy", {"zed": "USER_001", "amy": "USER_002"}),
]


def test_numbers_follow_the_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FIXED)], "i int, t string")
    got = {r.i: {x.value: x.alias for x in r.p} for r in df.select("i", X.personal(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(FIXED))] == [w for _, w in FIXED]
    r = df.where("i = 1").select(X.personal(F.col("t"), F.array(F.lit(" HPC-9"), F.lit("HPC-1"), F.lit(""))).alias("p")).first()
    assert {x.value: x.alias for x in r.p} == {"HPC-9": "TICKET_001", "HPC-1": "TICKET_002", "HPC-12": "TICKET_003", "b@x.org": "EMAIL_001", "a@x.org": "EMAIL_002"}


def test_partitions_of_a_command(spark):
    texts = {"sbatch -p alpha; srun -p beta": ["beta"], "#SBATCH -p a1\n\n  #sbatch --partition b2": ["a1", "b2"], "srun -p queue": [], "use x-long": ["x-long"], "salloc --partition=c # -p d": ["c"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.p for r in df.select("t", X.partitions(F.col("t")).alias("p")).collect()} == texts


def test_timestamps(spark):
    same = ["2024-02-29T10:00:00Z", "20240229T100000Z", "20240229T1000", "2024-02-29T10", "2024-02-29 10:00", "2024-02-29T11:00:00.0000000+0100", "20240229T110000+01:00", "2024-02-29T10:00:00,000", " 2024-02-29T10:00:00 "]
    none = ["2024022", "20240230", "2024-02-29T25", "2024-02-29X10", "10:00", "202402291000"]
    df = spark.createDataFrame([(t,) for t in same + none], "t string")
    assert {r.t: r.s for r in df.select("t", V.parse_timestamp(F.col("t")).alias("s")).collect()} == dict.fromkeys(same, 1709200800.0) | dict.fromkeys(none)


def test_queries_have_rows(spark, sf_dir):
    for name in ("partition_names", "module_tokens", "versions", "scope_families", "pii_detect"):
        assert QUERIES[name](spark, sf_dir).where("doc_id < 0").count() > 0
    got = {(r.doc_id, r.partition_name) for r in QUERIES["partition_names"](spark, sf_dir).collect()}
    assert {(-1, "icelake-himem"), (-1, "cclake"), (-1, "sapphire"), (-2, "sapphire-long"), (-2, "Icelake-Long")} <= got and not {(-1, "queue"), (-1, "ampere")} & got
    got = {(r.doc_id, r.module) for r in QUERIES["module_tokens"](spark, sf_dir).where("doc_id < 0").collect()}
    assert got == {(-3, m) for m in ("gcc/11.2.0", "openmpi-4.1", "python/3.9", "cuda/12.1")}


def test_sets_and_nulls(spark):
    df = spark.createDataFrame([([" A ", "a", "", None, "B"], None, None)], "x array<string>, y array<string>, t string")
    r = df.select(V.text_set(F.col("x")).alias("x"), V.text_set(F.col("y")).alias("y"), V.parse_timestamp(F.col("t")).alias("t"), X.partitions(F.col("t")).alias("p"), V.json_object(F.lit("[1]")).alias("j")).first()
    assert (r.x, r.y, r.t, r.p, r.j) == (["a", "b"], [], None, [], "{}")
