"""Byte regexes compiled by subset construction and minimisation into transition arrays.

Supported: literal bytes, ``\\xHH`` and escaped punctuation, classes with ranges, groups, ``|``, ``?``,
``*``, ``+``, ``{n}`` and ``{n,}``. All of it is over bytes, without anchors or look-around.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FOLD = {b: {b, b ^ 32} for b in [*range(65, 91), *range(97, 123)]}


class _Nfa:
    """Fragments are (start, end); an edge is a set of bytes, None an empty move."""

    def __init__(self, fold: bool = False):
        self.edges: list[list[tuple[frozenset | None, int]]] = []
        self.fold = fold

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def read(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        out = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return out

    def _either(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.edges[start].append((None, a))
            self.edges[b].append((None, end))
            if not self._next("|"):
                return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            a, b = self._repeated()
            self.edges[end].append((None, a))
            end = b
        return start, end

    def _next(self, char: str) -> bool:
        if self.text[self.at : self.at + 1] == char:
            self.at += 1
            return True
        return False

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        part = self._atom()
        stop = self.at
        if self._next("?"):
            least, most = 0, 1
        elif self._next("*"):
            least, most = 0, None
        elif self._next("+"):
            least, most = 1, None
        elif self._next("{"):
            close = self.text.index("}", self.at)
            low, comma, _ = self.text[self.at : close].partition(",")
            self.at, least, most = close + 1, int(low), None if comma else int(low)
        else:
            return part
        after, copies = self.at, [part]
        while len(copies) < max(least, 1):
            self.at = begin
            copies.append(self._atom())
            assert self.at == stop
        self.at = after
        start, end = self.state(), self.state()
        here = start
        for k, (a, b) in enumerate(copies):
            self.edges[here].append((None, a))
            if k >= least:
                self.edges[here].append((None, end))
            here = b
        self.edges[here].append((None, end))
        if most is None:
            self.edges[here].append((None, copies[-1][0]))
        return start, end

    def _atom(self) -> tuple[int, int]:
        if self._next("("):
            inner = self._either()
            if not self._next(")"):
                raise ValueError(f"missing ) in {self.text!r}")
            return inner
        allowed = self._class() if self._next("[") else {self._byte()}
        if self.fold:
            allowed = set().union(*(_FOLD.get(b, {b}) for b in allowed))
        start, end = self.state(), self.state()
        self.edges[start].append((frozenset(allowed), end))
        return start, end

    def _byte(self) -> int:
        char = self.text[self.at]
        self.at += 1
        if char != "\\":
            return ord(char)
        char = self.text[self.at]
        self.at += 1
        if char == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(char)

    def _class(self) -> set[int]:
        out: set[int] = set()
        while not self._next("]"):
            low = self._byte()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                out |= set(range(low, self._byte() + 1))
            else:
                out.add(low)
        return out


@dataclass
class Automaton:
    """``move[state, kind[byte]]`` is the next state, from 0; ``accept[state]`` a bit for each pattern."""

    kind: np.ndarray
    move: np.ndarray
    accept: np.ndarray

    @property
    def resets(self) -> np.ndarray:
        """Bytes after which the state is the first one, whatever it was."""
        return (self.move == 0).all(axis=0)[self.kind]


def compile_all(patterns: list[tuple[str, bool]], search: bool = False) -> Automaton:
    """One minimal automaton of all (pattern, either case) pairs; ``search`` lets a match begin anywhere."""
    nfa = _Nfa()
    first, ends = nfa.state(), []
    for pattern, fold in patterns:
        nfa.fold = fold
        a, b = nfa.read(pattern)
        nfa.edges[first].append((None, a))
        ends.append(b)

    # Bytes that no edge tells apart are one kind.
    sets = sorted({s for e in nfa.edges for s, _ in e if s is not None}, key=sorted)
    marks = np.array([[b in s for s in sets] for b in range(256)], bool).reshape(256, -1)
    _, sample, kind = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)

    def spread(states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for s, to in nfa.edges[todo.pop()]:
                if s is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    start = spread({first})
    known, order, table = {start: 0}, [start], []
    for group in order:  # grows while it is walked
        live = [(s, to) for q in group for s, to in nfa.edges[q] if s is not None]
        row = []
        for byte in sample.tolist():
            after = spread({to for s, to in live if byte in s} | ({first} if search else set()))
            if after not in known:
                known[after] = len(order)
                order.append(after)
            row.append(known[after])
        table.append(row)
    accept = np.array([sum(1 << k for k, e in enumerate(ends) if e in g) for g in order], np.int64)
    return Automaton(kind.astype(np.uint8), *_minimal(np.array(table, np.int64), accept))


def _minimal(move: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no continuation tells apart: classes are split until they stay."""
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        _, again = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)
        again = again.reshape(-1)
        if again.max() == block.max():
            break
        block = again
    # Number the classes by their first state, so the start stays 0.
    _, first = np.unique(block, return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    lead = np.sort(first)
    return rank[block][move[lead]].astype(np.int32), accept[lead]
