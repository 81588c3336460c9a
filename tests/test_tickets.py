"""Trees of rich text, roles, filters and blind sheets on small cases."""

import json

import pytest
from evidra.operators.ticket_documents import documents
from evidra.functions.filters import matches
from evidra.functions.tickets import rich_text, tree_text
from evidra.operators.blind import blind_key, blind_sheet
from pyspark.sql import functions as F


def text(t, **more):
    return {"type": "text", "text": t, **more}


def node(kind, *inner, **attrs):
    return {"type": kind, "content": list(inner), "attrs": attrs}


CASES = [
    (None, ""), ([], ""), (node("paragraph", text("Hello")), "Hello\n"), ([text("a"), text("b")], "ab"),
    (node("orderedList", node("listItem", node("paragraph", text("x"))), node("listItem", node("paragraph", text("y"))), order=3), "3. x\n4. y\n"),
    (node("bulletList", node("listItem", node("paragraph", text("- x")))), "- - x\n"),
    (node("heading", text(" T "), level=3), "### T\n"), (node("panel", node("paragraph", text("mind")), panelType="warning"), "WARNING: mind\n"),
    (node("codeBlock", text("ls"), language="bash"), "```bash\nls\n```\n"), (node("blockquote", node("paragraph", text("a")), node("paragraph"), node("paragraph", text("b"))), "> a\n\n> b\n"),
    (node("expand", node("paragraph", text("in")), title="More"), "More\n\nin\n"), (node("rule"), "\n---\n"),
    (node("table", node("tableRow", node("tableHeader", node("paragraph", text("h"))), node("tableCell", text(" c ")))), "| h|c|\n"),
    (node("tableRow", node("tableCell", node("paragraph", text(" a "))), node("tableCell", text("b"))), "|a|b|\n"),
    (node("mediaSingle", node("media", type="file")), "[FILE ATTACHMENT]\n"), (node("mention", id="7"), "@7"), (node("mention", text="@Ann", id="7"), "@Ann"),
    (node("paragraph", node("emoji", shortName=":x:"), node("hardBreak"), node("status", text="OPEN"), node("inlineCard", url="u"), node("date", timestamp="12")), ":x:\nOPENu12\n"),
    (text("c", marks=[{"type": "code"}, {"type": "link", "attrs": {"href": "u"}}]), "[`c`](u)"), (node("strange", node("paragraph", text("in"))), "in\n"),
]


def test_trees(spark):
    for tree, want in CASES:
        assert tree_text(tree) == want
    deep = text("x")
    for _ in range(5000):
        deep = node("paragraph", deep)
    assert tree_text(deep) == "x" + "\n" * 5000
    raw = [json.dumps(t) for t, _ in CASES] + [None, "", "no json", "3"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    assert [r.t for r in df.select("i", rich_text(F.col("raw")).alias("t")).orderBy("i").collect()] == [w for _, w in CASES] + [""] * 4


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"], 5), (2, None, None, None), (3, "b", [], 7)], "i int, k string, l array<string>, n int")
    got = lambda t: [r.i for r in df.where(matches(t)).orderBy("i").collect()]
    leaf = lambda k, o, v: {"key": k, "op": o, "value": v}
    assert got(None) == [1, 2, 3] and got({"k": "a", "n": 5}) == [1] and got(leaf("k", "!=", "a")) == [2, 3] and got(leaf("k", "==", None)) == [2]
    assert got(leaf("k", "in", ["a", "b"])) == [1, 3] and got(leaf("k", "nin", ["a"])) == [2, 3] and got(leaf("k", "in", "a")) == [] and got(leaf("k", "nin", [])) == [1, 2, 3]
    assert got(leaf("l", "any", ["x", "z"])) == [1] and got(leaf("l", "all", ["x", "y"])) == [1] and got(leaf("l", "all", [])) == [1, 3] and got(leaf("l", "any", "y")) == [1]
    assert got(leaf("n", ">", 5)) == [3] and got(leaf("n", "<=", 7)) == [1, 3] and got({"not": [leaf("n", ">=", 7), leaf("k", "==", "a")]}) == [2]
    assert got({"or": []}) == [] and got({"and": []}) == [1, 2, 3] and got({"or": [leaf("i", "==", 1), {"and": [leaf("k", "==", "b"), leaf("n", "<", 9)]}]}) == [1, 3]


def test_blind(spark):
    rows = [(q, c, f"{c}{q}") for q in range(40) for c in ("u", "v")]
    df = spark.createDataFrame(rows, "query_id int, condition string, response string")
    key = {(r.query_id, r.label): r.condition for r in blind_key(df, ["u", "v"]).collect()}
    assert len(key) == 80 and {key[q, "system_A"] for q in range(40)} == {"u", "v"}
    assert all(r.system_A == f"{key[r.query_id, 'system_A']}{r.query_id}" for r in blind_sheet(df, ["u", "v"]).collect())
    with pytest.raises(Exception, match="not every condition answers query 3"):
        blind_key(df.where(~((F.col("query_id") == 3) & (F.col("condition") == "u"))), ["u", "v"]).collect()


def test_ticket_documents(spark):
    person = lambda e, n=None: {"emailAddress": e, **({"displayName": n} if n else {})}
    para = lambda t: {"type": "paragraph", "content": [{"type": "text", "text": t}]}
    fields = {
        "summary": "Cannot access docs", "description": para("Initial  problem.  \r\n\n\n\nMore"), "status": {"name": "Resolved"}, "created": "2025-01-01T09:00:00.000+0000", "updated": "2025-01-01T10:00:00.000+0000", "resolutionDate": "2025-01-01T11:00:00.500+0000",
        "assignee": person("a@x"), "creator": person("c@x"), "reporter": person("r@x"), "customfield_10042": [person("p@x")],
        "comment": {"comments": [{"author": person("c@x", "C"), "body": para("First")}, {"author": person("a@x"), "body": para(" Reply ")}, {"author": person("p@x"), "body": None}, {"author": person("r@x"), "body": {"type": "doc", "content": [para("a"), {"type": "bulletList", "content": [{"type": "listItem", "content": [para("b")]}]}]}}, {"author": person("z", "Automation Pseudo-User"), "body": para("")}]},
    }
    bare = {"summary": None, "status": {"name": "open"}, "created": "2025-01-01T09:00:00.000+0000", "comment": {"comments": []}}
    df = spark.createDataFrame([("DEMO-1", json.dumps(fields)), ("DEMO-2", json.dumps(bare)), ("DEMO-3", "no json"), ("DEMO-4", None)], "key string, fields string")
    got = {r.key: r for r in documents(df).collect()}
    one = got["DEMO-1"]
    assert one.markdown == (
        "# Ticket DEMO-1\n\n- Summary: Cannot access docs\n- Status: RESOLVED\n- Created: 2025-01-01T09:00:00.000+0000\n- Updated: 2025-01-01T10:00:00.000+0000\n- Resolved: 2025-01-01T11:00:00.500+0000\n\n## Initial Description\n\nInitial  problem.\n\nMore\n\n## Conversation\n\n"
        "### Message 0001 (TICKET_CREATOR)\n\nFirst\n\n### Message 0002 (HELPDESK_ASSIGNEE)\n\nReply\n\n### Message 0003 (HELPDESK_PRINCIPAL_INVESTIGATOR)\n\n_Empty message._\n\n### Message 0004 (REPORTER)\n\na\n- b\n\n### Message 0005 (AUTOMATED_PSEUDOUSER)\n\n_Empty message._"
    )
    assert one.text.startswith("<BEGIN_TICKET>\n[TICKET_KEY] DEMO-1\n[STATUS] RESOLVED\n[CREATED] 2025-01-01T09:00:00.000+0000\n[SUMMARY] Cannot access docs\n\n[INITIAL_DESCRIPTION]\nInitial  problem.")
    assert "<MESSAGE id=0002 role=HELPDESK_ASSIGNEE>\nReply\n</MESSAGE>\n\n" in one.text and one.text.endswith("</MESSAGE>\n\n<END_TICKET>") and one.time_to_resolution == 7200.5
    assert got["DEMO-2"].markdown.endswith("## Initial Description\n\n_No description provided._\n\n## Conversation\n\n_No comments._") and got["DEMO-2"].time_to_resolution is None
    assert got["DEMO-3"].status == got["DEMO-4"].status == "" and got["DEMO-4"].text.startswith("<BEGIN_TICKET>\n[TICKET_KEY] DEMO-4\n")
