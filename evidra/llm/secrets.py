"""Operator 1: secret scan with one combined deterministic automaton.

The rules are compiled by subset construction and minimised into one transition table; a document is
read once, byte by byte, by that table for all rules. Where it says that rule r has a match ending
here, two small automata of that rule alone settle the span: the one of the reversed rule finds the
leftmost start not before the rule's last span, the anchored one the longest end from there. Only
bytes of matches are read again.

Defined cases: null text counts as empty and has no span; repeated rows each get their own result; an
empty table gives an empty one; spans are code points, the end exclusive; other columns stay, and
those that clash with a new one are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import length_hint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.automaton import Dfa, compile_rules
from evidra.llm.common import table, with_columns


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, leftmost and longest; a span that ``keep`` doesn't match whole is dropped afterwards.

    Least lengths stand in ``keep``: counters in patterns that can begin inside each other would multiply states.
    For the same reason ``tail`` is read only once ``pattern`` is found: the span goes on over its longest match.
    """

    kind: str
    pattern: str
    keep: str = ""
    tail: str = ""


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", r"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}"),
    Rule("access", r"AKIA[A-Z0-9]+", r".{20,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What stands between a key's lines, also where the text quotes, indents or escapes it; its headers; its lines. A
#: character that could be of a gap or of a line at any place would multiply states by the lengths counted so far.
_GAP, _HEAD, _LINE = r"(?:\x20\+?|[\t\r\n\"'>#*|,]|\\+[nrt]?)", r"[A-Z][A-Za-z]*-[A-Za-z]+:\x20?[A-Za-z0-9,-]+", r"[A-Za-z0-9+/=]"
#: A key is all up to its END line, which no other line of five hyphens precedes. Where none follows, it is what looks like
#: its headers and lines: runs of 20 and more, and after these the rest of a last line.
_KEY = rf"(?:(?:[^-]|-{{1,4}}[^-])*-{{5,}}END (?:[A-Z]+ )*PRIVATE KEY-----|(?:{_GAP}+{_HEAD})*(?:{_GAP}+{_LINE}{{20,}})+(?:{_GAP}+{_LINE}+)?|(?:{_GAP}+{_HEAD})*)"
#: Public token formats, which the combined automaton finds in the same pass.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r".{40,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]+", r".{20,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", tail=rf"{_KEY}(?:BEGIN (?:[A-Z]+ )*PRIVATE KEY-----{_KEY})*"),  # a next key may share the hyphens
)


class _Hit:
    """A state in which rules end. It can't be indexed, which stops the loop over bytes."""

    __slots__ = ("row", "rules")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.start = self._rows(compile_rules([r.pattern for r in rules], anywhere=True))
        self.whole = [compile_rules([r.pattern + r.tail], anywhere=False) for r in rules]
        self.back = [compile_rules([_reversed(r.pattern)], anywhere=False) for r in rules]
        self.keep = [re.compile(r.keep.encode()) if r.keep else None for r in rules]

    @staticmethod
    def _rows(dfa: Dfa) -> list:
        rows = [[None] * 256 for _ in dfa.rules]
        seen = []
        for s, rules in enumerate(dfa.rules):
            h = rows[s]
            if rules:
                h = _Hit()
                h.row, h.rules = rows[s], sorted(rules)
            seen.append(h)
        for s in range(len(rows)):
            rows[s][:] = [seen[t] for t in dfa.next[s * 256 : s * 256 + 256]]
        return seen[0]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start and then rule."""
        found: list[tuple[int, int, int]] = []
        last = [0] * len(self.rules)
        row, n, it = self.start, len(data), iter(data)
        while True:
            try:
                for b in it:
                    row = row[b]
                if type(row) is not _Hit:
                    break
                end, b = n, None
            except TypeError:  # row is a hit, and b the byte after it
                end = n - length_hint(it) - 1
            for k in row.rules:
                if end > last[k]:
                    a = self._begin(k, data, end, last[k])
                    if a >= 0:
                        last[k] = z = self._end(k, data, a)
                        if self.keep[k] is None or self.keep[k].fullmatch(data, a, z):
                            found.append((k, a, z))
            if b is None:
                break
            row = row.row[b]
        found.sort(key=lambda x: (x[1], x[0]))
        return found

    def _begin(self, k: int, data: bytes, end: int, bound: int) -> int:
        dfa, s, best = self.back[k], 0, -1
        for i in range(end - 1, bound - 1, -1):
            s = dfa.next[s * 256 + data[i]]
            if s < 0:
                break
            if dfa.rules[s]:
                best = i
        return best

    def _end(self, k: int, data: bytes, a: int) -> int:
        dfa, s, best = self.whole[k], 0, a
        for i in range(a, len(data)):
            s = dfa.next[s * 256 + data[i]]
            if s < 0:
                break
            if dfa.rules[s]:
                best = i + 1
        return best


def _reversed(pattern: str) -> str:
    """The pattern of the reversed words, for the few forms that rules have."""
    import re._constants as C
    import re._parser as parser

    def text(tree) -> str:
        return "".join(reversed([item(op, a) for op, a in tree]))

    def char(x: int) -> str:
        return f"\\x{x:02x}"

    def item(op, a) -> str:
        if op is C.LITERAL:
            return char(a)
        if op is C.IN:
            neg = "^" if a[0][0] is C.NEGATE else ""
            return "[" + neg + "".join(char(x) if kind is C.LITERAL else f"{char(x[0])}-{char(x[1])}" for kind, x in a if kind is not C.NEGATE) + "]"
        if op is C.BRANCH:
            return "(?:" + "|".join(text(t) for t in a[1]) + ")"
        if op is C.SUBPATTERN:
            return f"(?{'i' if a[1] & 2 else ''}:{text(a[3])})"
        if op is C.MAX_REPEAT:
            low, high, sub = a
            return f"(?:{text(sub)}){{{low},{'' if high is C.MAXREPEAT else high}}}"
        raise ValueError(f"a rule uses {op}")

    return text(parser.parse(pattern))


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans' byte offsets as code points; each byte between spans is decoded once."""
    at, chars, of = 0, 0, {}
    for x in sorted({x for _, a, z in spans for x in (a, z)}):
        chars += sum(1 for c in data[at:x] if c & 0xC0 != 0x80) if x - at < 64 else len(data[at:x].decode("utf-8", "replace"))
        of[x], at = chars, x
    return [(k, of[a], of[z]) for k, a, z in spans]


def scan_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Adds ``secrets``: array of (kind, start, end, value) of every span, by start and then rule."""
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        s = scanner(rules)
        names = [r.kind for r in rules]
        for texts in batches:
            out = []
            for t in texts:
                got = s.spans(t) if t else []
                out.append([{"kind": names[k], "start": a, "end": z, "value": t[x:y].decode()} for (k, a, z), (_, x, y) in zip(in_code_points(t, got), got, strict=True)] if got else [])
            yield [out]

    return with_columns(df, text, [T.StructField("secrets", T.ArrayType(kind))], run)


def redact_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Replaces every span by ``[KIND]``; overlapping spans are replaced together, under the first one's kind."""

    def run(batches: Iterator[list]) -> Iterator[list[list]]:
        s = scanner(rules)
        for texts in batches:
            out = []
            for t in texts:
                if got := s.spans(t) if t else []:
                    parts, at = [], 0
                    for k, a, z in got:
                        if a >= at:
                            parts += [t[at:a], f"[{rules[k].kind.upper()}]".encode()]
                        at = max(at, z)
                    t = b"".join([*parts, t[at:]])
                out.append(None if t is None else t.decode())
            yield [out]

    order = df.columns
    return with_columns(df, text, [T.StructField(text, T.StringType())], run).select(*[F.col(f"`{c}`") for c in order])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: counts, the base spans' digest, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in BASE]))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by Python's own matcher, for tests."""
    out, text = [], text or ""
    keys = r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))"
    out += [("assign", *m.span()) for m in re.finditer(keys + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], rank[x[0]]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
