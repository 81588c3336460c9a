"""Metadata filters: a tree of conditions as one column, which Spark pushes to the scan as far as it can."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _leaf(key: str, op: str, value) -> Column:
    """Nulls: equal to a null alone, other than every value, in no order with any, in no list; in lists that hold none of them."""
    c = F.col(f"`{key}`")
    many = value if isinstance(value, (list, tuple, set, frozenset)) else None
    listed = F.coalesce(c.isin(*many), F.lit(False)) if many else F.lit(False)
    ordered = {">": c > F.lit(value), ">=": c >= F.lit(value), "<": c < F.lit(value), "<=": c <= F.lit(value)} if op in (">", ">=", "<", "<=") else {}
    if op in ordered:
        return F.coalesce(ordered[op], F.lit(False))
    if op == "!=":
        return ~c.eqNullSafe(F.lit(value))
    if op == "in":
        return listed
    if op == "nin":
        return ~listed
    if op in ("any", "all"):
        wanted = [F.array_contains(c, F.lit(v)) for v in (many if many is not None else [value])]
        out = F.lit(op == "all")
        for w in wanted:
            out = (out & w) if op == "all" else (out | w)
        return F.coalesce(out, F.lit(False)) & c.isNotNull()
    return c.eqNullSafe(F.lit(value))  # also for an operator that isn't known


def matches(tree: Mapping | None) -> Column:
    """``{"and" | "or" | "not": [trees]}`` or ``{"key": k, "op": o, "value": v}``; other maps: all keys equal; none: all rows.

    ``not`` holds where none of its trees does.
    """
    if tree is None:
        return F.lit(True)
    if "key" in tree:
        return _leaf(tree["key"], str(tree.get("op", "==")).lower(), tree.get("value"))
    for kind in ("and", "or", "not"):
        if kind in tree:
            out = F.lit(kind == "and")
            for t in tree[kind]:
                out = (out & matches(t)) if kind == "and" else (out | matches(t))
            return ~out if kind == "not" else out
    return matches({"and": [{"key": k, "value": v} for k, v in tree.items()]})
