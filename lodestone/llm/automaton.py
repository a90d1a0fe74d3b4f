"""Regular expressions over bytes to minimal deterministic automata, by subset construction and partition refinement;
automata that find the spans of many rules in one pass.

Syntax: literals, \\xHH and escaped metacharacters, [classes], ( ), |, *, +, ?, {m}, {m,}, {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

META = "()[]{}|*+?\\"


class _Parser:
    """Gives a tree of ("set", frozenset), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        if self.peek() == "x":
            self.i += 3
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(self.take())

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        c = self.peek()
        if c == "(":
            self.take()
            atom = self.alternatives()
            self.take()
        elif c == "[":
            self.take()
            atom = ("set", self.members())
        else:
            atom = ("set", frozenset([self.char()]))
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                a, comma, b = self.s[self.i : end].partition(",")
                self.i = end + 1
                atom = ("rep", atom, int(a), int(b) if b else None if comma else int(a))
            else:
                atom = ("rep", atom, int(c == "+"), 1 if c == "?" else None)
        return atom

    def members(self) -> frozenset[int]:
        found: set[int] = set()
        while self.peek() != "]":
            a = self.char()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                found.update(range(a, self.char() + 1))
            else:
                found.add(a)
        self.take()
        return frozenset(found)


def parse(pattern: str):
    return _Parser(pattern).alternatives()


def backwards(tree):
    """The tree of the reversed strings."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [backwards(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [backwards(x) for x in tree[1]])
    return ("rep", backwards(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.on) - 1

    def build(self, tree, start: int) -> int:
        """Adds the tree after start and returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.on[start] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                end = self.build(part, start)
                start = self.state()
                self.free[end].append(start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(("cat", [part]), start)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            first = self.state()
            self.free[start].append(first)
            last = self.build(part, first)
            self.free[last] += [first, end]
        else:
            for _ in range(most - least):
                first = self.state()
                self.free[start].append(first)
                start = self.build(("cat", [part]), first)
                self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """classes: 256 bytes, the class of each byte. table[state][class]: next state; state 0 starts. accepts[state]: bit k set if pattern k ends here."""

    classes: bytes
    table: tuple[tuple[int, ...], ...]
    accepts: tuple[int, ...]


def _letters(tree) -> frozenset:
    """The byte sets of a tree."""
    if tree[0] == "set":
        return frozenset([tree[1]])
    return frozenset().union(*map(_letters, tree[1] if tree[0] in ("cat", "alt") else [tree[1]]))


def _byte_classes(sets) -> tuple[bytes, list[int]]:
    """The class of each byte, as the sets tell bytes apart, and a byte of each class. sets: byte sets, or sets of them."""
    flat = sorted({x for s in sets for x in (s if s and isinstance(next(iter(s)), frozenset) else [s])}, key=sorted)
    keys: dict[tuple[bool, ...], int] = {}
    classes = bytes(keys.setdefault(tuple(b in s for s in flat), len(keys)) for b in range(256))
    return classes, [classes.index(c) for c in range(len(keys))]


def compile_patterns(trees: list, anchored: bool) -> Automaton:
    """One automaton for all trees. Not anchored: a match may begin at any byte."""
    nfa = _Nfa()
    ends, starts = {}, []
    for k, tree in enumerate(trees):
        starts.append(s := nfa.state())
        ends[nfa.build(tree, s)] = k
    classes, sample = _byte_classes([x[0] for x in nfa.on if x])
    first = nfa.closed(starts)
    moves = {q: (x[0], nfa.closed([x[1]])) for q, x in enumerate(nfa.on) if x}
    again = first if not anchored else frozenset()
    number, todo, table = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            new = set(again)
            for q in now:
                m = moves.get(q)
                if m and b in m[0]:
                    new |= m[1]
            new = frozenset(new)
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
        table.append(row)
    accepts = [sum(1 << ends[q] for q in s if q in ends) for s in number]
    return _minimal(classes, table, accepts)


def _minimal(classes: bytes, table: list[list[int]], accepts: list[int]) -> Automaton:
    """States that no continuation tells apart become one; 0 stays the start."""
    part, n = accepts, -1
    while True:
        keys: dict = {}
        part = [keys.setdefault((part[q], *(part[t] for t in row)), len(keys)) for q, row in enumerate(table)]
        if len(keys) == n:
            break
        n = len(keys)
    one = {p: q for q, p in reversed(list(enumerate(part)))}  # the first state of each part
    return Automaton(classes, tuple(tuple(part[t] for t in table[one[p]]) for p in range(n)), tuple(accepts[one[p]] for p in range(n)))


@dataclass(frozen=True)
class Search:
    """One deterministic automaton that finds the leftmost, longest, non-overlapping matches of each of several rules.

    classes: 256 bytes, the class of each byte. table[state, class]: the next state; state 0 starts. done[state, class]: bit k is
    set if a match of rule k ended before the byte that is read. last[state]: bit k is set if a match of rule k ends here and the
    text too."""

    classes: bytes
    table: np.ndarray
    done: np.ndarray
    last: np.ndarray


def _searcher(tree, sample: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """table, done and last of one rule.

    A state holds the sets of places inside the rule that threads are at, a set for each start of a thread, the oldest first,
    and whether the oldest has just matched. A match ends the younger threads, which overlap it. That a match is whole is known
    when its thread does not go on; the threads that are left began after it."""
    nfa = _Nfa()
    start = nfa.state()
    end = nfa.build(tree, start)
    first = nfa.closed([start])
    if end in first:
        raise ValueError("a rule that matches nothing at all has no spans")
    moves = {q: (x[0], nfa.closed([x[1]])) for q, x in enumerate(nfa.on) if x}
    number: dict = {((), False): 0}
    todo, table, done = [((), False)], [], []
    for threads, matched in todo:
        row, out = [], []
        for b in sample:
            seen: set[int] = set()
            moved = []
            for places in (*threads, first):
                to = frozenset(t for q in places if q in moves and b in moves[q][0] for t in moves[q][1]) - seen
                seen |= to
                moved.append(to)
            over = matched and not moved[0]
            if matched and not over and end not in moved[0]:
                raise ValueError("a rule must not go on after a match without matching again")
            moved = [m for m in moved if m]
            hit = next((i for i, m in enumerate(moved) if end in m), None)
            if hit:
                raise ValueError("a match must not lie inside what an earlier start may still match")
            state = ((moved[0],), True) if hit == 0 else (tuple(moved), False)
            if state not in number:
                number[state] = len(number)
                todo.append(state)
            row.append(number[state])
            out.append(over)
        table.append(row)
        done.append(out)
    return np.array(table), np.array(done), np.array([m for _, m in number])


def search(trees: list) -> Search:
    """The automata of the rules by subset construction, their product (what the subset construction of all rules at once
    would reach), and its minimisation. Raises ValueError for rules whose matches could not be told in one pass."""
    classes, sample = _byte_classes([_letters(t) for t in trees])
    parts = [_searcher(t, sample) for t in trees]
    sizes = [len(t) for t, _, _ in parts]
    radix = np.cumprod([1, *sizes[:-1]]).astype(object)
    if int(radix[-1]) * sizes[-1] >= 1 << 62 or len(trees) > 31:
        raise ValueError("too many rules for one automaton")  # their codes would not fit in 64 bits
    radix = radix.astype(np.int64)
    codes, frontier, rows = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(frontier):
        rows.append((frontier, sum(t[frontier // r % len(t)].astype(np.int64) * r for (t, _, _), r in zip(parts, radix, strict=True))))
        frontier = np.setdiff1d(np.unique(rows[-1][1]), codes)
        codes = np.concatenate([codes, frontier])
    own, to = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    order = np.argsort(own)  # the start is code 0 and stays first
    own, table = own[order], np.searchsorted(own[order], to[order])
    done = sum(d[own // r % len(d)].astype(np.int64) << k for k, ((_, d, _), r) in enumerate(zip(parts, radix, strict=True)))
    last = sum(m[own // r % len(m)].astype(np.int64) << k for k, ((_, _, m), r) in enumerate(zip(parts, radix, strict=True)))
    part, n = np.unique(np.column_stack([done, last]), axis=0, return_inverse=True)[1].reshape(-1), 0
    while part.max() + 1 > n:  # states that no continuation tells apart become one
        n = part.max() + 1
        part = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
    one = np.unique(part, return_index=True)[1]
    swap = np.arange(n)
    swap[[0, part[0]]] = part[0], 0  # the start is state 0
    return Search(classes, swap[part[table[one]]][swap].astype(np.int32), done[one][swap].astype(np.int32), last[one][swap].astype(np.int32))
