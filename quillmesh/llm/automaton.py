"""Byte automata: regular expressions to minimal deterministic transition arrays.

Syntax: literals, ``\\xHH`` and other escapes, classes with ranges and negation, groups,
alternation, and the quantifiers ``? * + {m} {m,} {m,n}``.  Patterns are over bytes and unanchored
text is handled by the search automaton, which may start any rule at every byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """A pattern to a tree: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                close = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : close].partition(",")
                self.i = close + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            part = ("rep", part, least, most)
        return part

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            inner = self.alternatives()
            if not self.peek():
                raise ValueError("a group is not closed")
            self.take()
            return inner
        if c == "[":
            return ("set", self.charset())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset(self.escaped() if c == "\\" else c.encode()))

    def escaped(self) -> bytes:
        c = self.take()
        if c == "x":
            self.i += 2
            return bytes([int(self.p[self.i - 2 : self.i], 16)])
        return {"n": b"\n", "t": b"\t", "r": b"\r"}.get(c, c.encode())

    def charset(self) -> frozenset:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = (self.escaped() if c == "\\" else c.encode())[0]
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                high = (self.escaped() if c == "\\" else c.encode())[0]
                out.update(range(low, high + 1))
            else:
                out.add(low)
        self.take()
        return frozenset(set(range(256)) - out if negated else out)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds ``node`` from ``start``; the state in which it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.moves[mid] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.empty[self.build(part, start)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.build(part, start)
            self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """A minimal deterministic automaton. ``accepts`` has a bit for each rule."""

    classes: np.ndarray  # byte -> class
    table: np.ndarray  # state * number of classes + class -> state
    accepts: np.ndarray  # state -> bits
    start: int
    width: int  # number of classes
    dead: int  # state without a way to accept, or -1

    def __post_init__(self):
        rows = self.table.reshape(-1, self.width)
        self.rows = [tuple(r) for r in rows[:, self.classes].tolist()]
        self.ends = self.accepts.tolist()
        # the bits of rules that a state can still come to accept
        reach = self.accepts.copy()
        while True:
            more = reach | np.bitwise_or.reduce(reach[rows], axis=1)
            if (more == reach).all():
                break
            reach = more
        self.reach = reach.tolist()

    def resets(self) -> np.ndarray:
        """Bytes after which every state is the start."""
        rows = self.table.reshape(-1, self.width)
        return (rows == self.start).all(axis=0)[self.classes]

    def pair_resets(self) -> np.ndarray:
        """Pairs of classes after which every state is the start, as a flag at [first, second]."""
        rows = self.table.reshape(-1, self.width)
        return (rows[rows] == self.start).all(axis=0)

    def longest(self, data: bytes, at: int, upto: int, bit: int = 1, mark: int = 0) -> tuple[int, int]:
        """Ends of the longest match of the rule ``bit``, and of the one of ``mark`` within it, that start at ``at``; -1 if there is none."""
        rows, ends, reach, state, found, inner, last = self.rows, self.ends, self.reach, self.start, -1, -1, -1
        for i in range(at, upto):
            state = rows[state][data[i]]
            if not reach[state] & bit:
                break
            accepts = ends[state]
            if accepts & mark:
                inner = i + 1
            if accepts & bit:
                found, last = i + 1, inner
        return found, last

    def starts(self, data: bytes, at: int, upto: int) -> list[tuple[int, int]]:
        """(place, rules) where a match begins, from left to right, for an automaton that reads backwards."""
        rows, ends, state, out = self.rows, self.ends, self.start, []
        for i in range(upto - 1, at - 1, -1):
            state = rows[state][data[i]]
            if ends[state]:
                out.append((i, ends[state]))
        out.reverse()
        return out


def _mirrored(node):
    """The tree of the same texts read backwards."""
    kind = node[0]
    if kind == "cat":
        return ("cat", [_mirrored(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_mirrored(x) for x in node[1]])
    return ("rep", _mirrored(node[1]), *node[2:]) if kind == "rep" else node


def compile_rules(patterns: list[str], search: bool, backwards: bool = False) -> Automaton:
    """One automaton for all patterns; with ``search`` they may begin at any byte, ``backwards`` reads from right to left."""
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        parser = _Parser(pattern)
        own = nfa.state()
        nfa.empty[root].append(own)
        tree = parser.alternatives()
        end = nfa.build(_mirrored(tree) if backwards else tree, own)
        if parser.i != len(pattern):
            raise ValueError(f"cannot parse {pattern!r}")
        finals[end] = finals.get(end, 0) | 1 << k
    closed: dict[int, frozenset] = {}

    def closure(s: int) -> frozenset:
        if s not in closed:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closed[s] = frozenset(x for x in seen if nfa.moves[x] or x in finals)
        return closed[s]

    # bytes that no set tells apart form a class
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    marks = [tuple(b in x for x in sets) for b in range(256)]
    kinds = list(dict.fromkeys(marks))
    classes = np.array([kinds.index(m) for m in marks], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]
    # subsets
    first = closure(root)
    number = {first: 0}
    table: list[list[int]] = []
    todo = [first]
    for subset in todo:
        row = []
        for byte in sample:
            to: set[int] = set()
            for s in subset:
                move = nfa.moves[s]
                if move and byte in move[0]:
                    to |= closure(move[1])
            key = frozenset(to) | first if search else frozenset(to)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
        table.append(row)
    accepts = np.zeros(len(number), np.int64)
    for subset, k in number.items():
        for end, bits in finals.items():
            if end in subset:
                accepts[k] |= bits
    return _minimised(classes, np.array(table), accepts)


def _minimised(classes: np.ndarray, rows: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Partition refinement: states are split until each block agrees on where every class leads."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        key = np.concatenate([block[:, None], block[rows]], axis=1)
        finer = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    one = np.zeros(n, np.int64)
    one[block] = np.arange(len(block))
    table = block[rows[one]]
    final = accepts[one]
    loops = (table == np.arange(n)[:, None]).all(axis=1) & (final == 0)
    dead = int(np.flatnonzero(loops)[0]) if loops.any() else -1
    return Automaton(classes, table.astype(np.int32).reshape(-1), final, int(block[0]), rows.shape[1], dead)
