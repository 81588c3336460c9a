import hashlib
import zlib

import duckdb
import pytest

from evidra.llm import prefix_trie as P
from evidra.llm import sql
from evidra.llm.prefix_trie import op13_prefix_trie, prefix_trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(turns):
    """The contract on (conv_id, turn, role, text) rows, with tuples as nodes."""
    by = {}
    for c, n, role, text in turns:
        if c is not None:
            by.setdefault(c, []).append((n is not None, n or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in by.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for x, members in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        childless = [y for y in below if not any(len(z) > len(y) and z[: len(y)] == y for z in below)]
        saved = sum((len(nodes[y]) - 1) * len(y[-1][1].encode()) for y in below if y)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == x)
        kids = sum(len(y) == len(x) + 1 for y in below)
        out.append((min(members), len(x), min(nodes[x[:-1]]) if x else None, len(members), kids, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r[n] for n in NAMES)) for r in df.collect())


CASES = {
    "copies": [(c, t, "user", f"t{t}") for c in range(60) for t in range(c % 4 + 1)],
    "branches": [(c, t, "ua"[t % 2], f"é{(c >> t) % 2}" * (t + 1)) for c in range(40) for t in range(5)],
    "long": [(7, t, "u", f"{t % 3}") for t in range(400)] + [(5, t, "u", f"{t % 3}") for t in range(11)],
    "odd": [(1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (None, 0, "u", "x"), (2, 3, "u", "b"), (2, 3, "u", "a"), (2, 3, "a", "z"), (2, None, "u", "n"), (-3, 0, "u", "x"), (-5, 0, "u", "w" * 9), (-5, 1, "u", "x"), (2**52, 0, "", "x" * 200_000)],
    "one repeated turn": [(3, 1, "u", "same")] * 50 + [(0, 1, "u", "same")] * 12,
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    df = spark.createDataFrame([(*r, 5, 1) for r in CASES[case]], "conv_id long, turn long, role string, text string, depth int, n_convs int")
    assert rows(prefix_trie(df, "conv_id", "turn", "role", "text")) == brute(CASES[case])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df, "conv_id", "turn", "role", "text").count() == 0


def test_query_and_sql(spark, sf_dir):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = op13_prefix_trie(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.execute(sql.ORACLES["op13_prefix_trie"])
    assert [c[0] for c in want.description] == got.columns
    assert rows(got) == brute(turns) == sorted(str(tuple(r)) for r in want.fetchall())
