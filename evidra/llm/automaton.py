"""One deterministic byte automaton for many rules: Thompson NFA, subset construction, minimisation."""

from __future__ import annotations

import re._constants as C  # the standard library's own pattern parser
import re._parser as parser
from dataclasses import dataclass

ASCII_FOLD = [{b, b ^ 32} if chr(b).isalpha() and b < 128 else {b} for b in range(256)]


class Nfa:
    """States are numbers; ``step[s]`` lists (set of bytes, target) and ``free[s]`` empty moves."""

    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Hangs a parsed pattern on state ``at`` and returns where it ends."""
        for op, arg in tree:
            at = self._item(op, arg, at, fold)
        return at

    def _item(self, op, arg, at: int, fold: bool) -> int:
        if op in (C.LITERAL, C.IN, C.NOT_LITERAL, C.ANY):
            to = self.state()
            self.step[at].append((_bytes(op, arg, fold), to))
            return to
        if op is C.SUBPATTERN:
            _, on, _, sub = arg
            return self.add(sub, at, fold or bool(on & 2))
        if op is C.BRANCH:
            end = self.state()
            for sub in arg[1]:
                self.free[self.add(sub, at, fold)].append(end)
            return end
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            for _ in range(low):
                at = self.add(sub, at, fold)
            if high is C.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.free[at].append(loop)
                self.free[loop].append(end)
                self.free[self.add(sub, loop, fold)].append(loop)
                return end
            end = self.state()
            self.free[at].append(end)
            for _ in range(high - low):
                at = self.add(sub, at, fold)
                self.free[at].append(end)
            return end
        raise ValueError(f"a rule uses {op}, which a byte automaton has no form for")

    def closure(self, states) -> frozenset[int]:
        out = set(states)
        todo = list(out)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    if op is C.ANY:
        return frozenset(set(range(256)) - {10})
    if op is C.LITERAL:
        got = {arg}
    elif op is C.NOT_LITERAL:
        return frozenset(set(range(256)) - {arg})
    else:
        got = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                got.add(x)
            elif kind is C.RANGE:
                got.update(range(x[0], x[1] + 1))
            elif kind is not C.NEGATE:
                raise ValueError(f"a rule uses the class {x}; list its bytes instead")
        if arg and arg[0][0] is C.NEGATE:
            return frozenset(set(range(256)) - got)
    if max(got) > 127:
        raise ValueError("rules are of ASCII characters")
    return frozenset(x for b in got for x in (ASCII_FOLD[b] if fold else (b,)))


@dataclass(frozen=True)
class Dfa:
    """``next[s * 256 + b]`` is the state after byte ``b``; -1: no match can follow. ``rules[s]``: those that end there."""

    next: tuple[int, ...]
    rules: tuple[frozenset[int], ...]


def compile_rules(patterns: list[str], anywhere: bool) -> Dfa:
    """All patterns as one minimal automaton. ``anywhere``: a match may begin at every byte."""
    nfa, ends = Nfa(), {}
    start = nfa.state()
    for k, p in enumerate(patterns):
        ends[nfa.add(parser.parse(p), start, False)] = k
    sets = list(dict.fromkeys(on for moves in nfa.step for on, _ in moves))
    kinds: dict[tuple, int] = {}
    class_of = [kinds.setdefault(tuple(b in on for on in sets), len(kinds)) for b in range(256)]  # bytes that no rule tells apart
    one = [class_of.index(k) for k in range(len(kinds))]
    first = nfa.closure([start])
    number, todo, moves, accept = {first: 0}, [first], [], []
    while todo:
        s = todo.pop(0)
        accept.append(frozenset(ends[x] for x in s if x in ends))
        row = []
        for b in one:
            t = nfa.closure(t for x in s for on, t in nfa.step[x] if b in on) | (first if anywhere else frozenset())
            if t and t not in number:
                number[t] = len(number)
                todo.append(t)
            row.append(number[t] if t else -1)
        moves.append(row)
    return _minimal(moves, accept, class_of)


def _minimal(moves: list[list[int]], accept: list[frozenset[int]], class_of: list[int]) -> Dfa:
    """Moore's refinement: states part until those of one block move alike on every byte."""
    kinds = {a: k for k, a in enumerate(dict.fromkeys(accept))}
    block = [kinds[a] for a in accept]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((block[s], tuple(-1 if t < 0 else block[t] for t in row)), len(seen)) for s, row in enumerate(moves)]
        if len(seen) == len(set(block)):
            break
        block = new
    order = {b: k for k, b in enumerate(dict.fromkeys(block))}  # the start stays 0
    first = {}
    for s, b in enumerate(block):
        first.setdefault(order[b], s)
    table = [(-1 if t < 0 else order[block[t]]) for k in range(len(order)) for t in (moves[first[k]][c] for c in class_of)]
    return Dfa(tuple(table), tuple(accept[first[k]] for k in range(len(order))))
