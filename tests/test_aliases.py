"""The alias scan against a plain loop of bounded regexes."""

import random
import re

import pytest

from evidra.operators import aliases
from evidra.operators.aliases import alias_scan
from evidra.plans.registry import QUERIES

ALIASES = ["NATION_7", "nation_1", "GPU node", "open-mpi", "a/b", "v2.1", "c++", ".net", "mit", "License", " slurm ", "++", r"a\Eb", "é", "nation", "", None]


def loop(text, aliases):
    names = {a.strip() for a in aliases if a and a.strip()}
    return {a.lower() for a in names if re.search(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])", text or "", re.IGNORECASE)}


@pytest.mark.parametrize("sent", [8 << 20, 0])
def test_like_a_regex_loop(spark, sent, monkeypatch):
    monkeypatch.setattr(aliases, "SENT", sent)
    rng = random.Random(1)
    parts = [a for a in ALIASES if a] + ["nation_77", "gpu  node", "GPU Node", "v2", "1", "open", "mpi", "x", "a", "b", "c+", "net", "Nation_1", "é"]
    texts = ["see nation_7.", "nation_71 xnation_7 nation 7", "a GPU NODE here", None, ""]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", "_", "-", "."]) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "mit"), (None, "open-mpi")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.alias) for r in alias_scan(df, spark.createDataFrame([(a,) for a in ALIASES], "alias string")).collect())
    assert got == sorted((str(i), a) for i, t in rows for a in loop(t, ALIASES))
    assert ("0", "nation_7") in got and ("2", "gpu node") in got and not any(k == "1" and a != "nation" for k, a in got)


def test_query_finds_names_with_underscores(spark, tmp_path):
    spark.createDataFrame([(1, "from Nation_7, MIT"), (2, "nation_70")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("NATION_7",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(map(tuple, QUERIES["alias_scan"](spark, str(tmp_path)).collect())) == [(1, "mit"), (1, "nation_7")]
