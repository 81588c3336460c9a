"""Tickets: roles of comments, and rich-text trees (nested JSON nodes) as plain text."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The automation's name and the names of roles.
AUTOMATION = "Automation Pseudo-User"


def comment_role(name: Column, email: Column, assignee: Column, creator: Column, investigator: Column, reporter: Column) -> Column:
    """The role of a comment's author by e-mail; the reporter counts only where someone else created the ticket. Missing e-mails are empty."""
    own = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(own(name) == AUTOMATION, "AUTOMATED_PSEUDOUSER").when(own(email) == own(assignee), "HELPDESK_ASSIGNEE").when(own(email) == own(creator), "TICKET_CREATOR")
        .when(own(email) == own(investigator), "HELPDESK_PRINCIPAL_INVESTIGATOR").when((own(creator) != own(reporter)) & (own(email) == own(reporter)), "REPORTER").otherwise("OTHER")
    )


class Node:
    """A node whose children are already text: ``parts`` one by one, ``kinds`` their types."""

    def __init__(self, raw: dict, parts: list[str], kinds: list[str], cells: list[list[str]]) -> None:
        self.raw, self.parts, self.kinds, self.cells = raw, parts, kinds, cells
        self.whole = "".join(parts)

    def attr(self, name: str, default="") -> str:
        return (self.raw.get("attrs") or {}).get(name, default)

    def items(self, mark: Callable[[int], str]) -> str:
        inner = [(p.strip().removeprefix("- ") if k == "listItem" else p.strip()) for p, k in zip(self.parts, self.kinds)]
        return "".join(f"{mark(i)} {x}\n" for i, x in enumerate(inner))

    def text(self) -> str:
        out = self.raw.get("text", "")
        marks = {m.get("type"): m for m in reversed(self.raw.get("marks") or [])}
        if "code" in marks:
            out = f"`{out}`"
        href = (marks.get("link", {}).get("attrs") or {}).get("href")
        return f"[{out}]({href})" if href else out


#: How each kind of node reads. Kinds not listed are their children's text.
READS: dict[str, Callable[[Node], str]] = {
    "text": Node.text,
    "hardBreak": lambda n: "\n",
    "rule": lambda n: "\n---\n",
    "paragraph": lambda n: n.whole + "\n",
    "heading": lambda n: f"{'#' * n.attr('level', 1)} {n.whole.strip()}\n",
    "panel": lambda n: f"{n.attr('panelType', 'info').upper()}: {n.whole.strip()}\n",
    "codeBlock": lambda n: f"```{n.attr('language')}\n{n.whole}\n```\n",
    "blockquote": lambda n: "\n".join(x and f"> {x}" for x in n.whole.splitlines()) + "\n",
    "expand": lambda n: f"{n.attr('title')}\n\n{n.whole.strip()}\n",
    "nestedExpand": lambda n: f"{n.attr('title')}\n\n{n.whole.strip()}\n",
    "bulletList": lambda n: n.items(lambda i: "-"),
    "orderedList": lambda n: n.items(lambda i: f"{n.attr('order', 1) + i}."),
    "listItem": lambda n: f"- {n.whole.strip()}\n",
    "table": lambda n: "".join(f"| {'|'.join(cells)}|\n" for cells in n.cells),
    "tableRow": lambda n: f"|{'|'.join(n.parts)}|\n",
    "tableCell": lambda n: n.whole.strip(),
    "tableHeader": lambda n: n.whole.strip(),
    "media": lambda n: f"[{n.attr('type', 'unknown').upper()} ATTACHMENT]\n",
    "mention": lambda n: n.attr("text") or f"@{n.attr('id', 'mention')}",
    "emoji": lambda n: n.attr("shortName"),
    "status": lambda n: n.attr("text"),
    "inlineCard": lambda n: n.attr("url") or "",
    "date": lambda n: str(n.attr("timestamp") or ""),
}


def tree_text(tree: dict | list | None) -> str:
    """A tree as text, read from its leaves up without recursion, so no depth is too much."""
    if not tree:
        return ""
    root = {"type": "", "content": tree} if isinstance(tree, list) else tree
    made: dict[int, str] = {}
    rows: dict[int, list[str]] = {}  # what a node's children read, for the table above it
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        inner = node.get("content") or []
        if not ready:
            todo += [(node, True), *((c, False) for c in inner)]
            continue
        n = Node(node, [made.pop(id(c)) for c in inner], [c.get("type") for c in inner], [rows.pop(id(c), []) for c in inner])
        rows[id(node)] = [p.strip() for p in n.parts]
        made[id(node)] = READS.get(node.get("type"), lambda n: n.whole)(n)
    return made[id(root)]


def read_tree(raw: str | None) -> str:
    """The text of a JSON tree; null and what is no JSON tree are empty."""
    try:
        tree = json.loads(raw or "null")
    except ValueError:
        return ""
    return tree_text(tree) if isinstance(tree, (dict, list)) else ""


def _texts(trees: pd.Series) -> pd.Series:
    return trees.map(read_tree)


def rich_text(trees: Column) -> Column:
    """JSON trees to text; null and what is no JSON tree are empty. The tree's depth keeps this from being a column expression."""
    return F.pandas_udf(_texts, "string")(trees)
