"""Rules' regular expressions as one deterministic automaton over bytes.

Expressions become a nondeterministic automaton, subset construction and minimisation make it
deterministic, and its transitions are one flat array over classes of bytes. The combined automaton reads
the reversed rules, so that one pass from the end of a text to its start marks every byte where some rule's
match begins, for all rules at once. A forward automaton of the one rule then runs from the marks to the
match's end, which touches matches only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Rule:
    """A kind of finding and its expression; a match whose group ``group`` has under ``least`` characters is dropped."""

    kind: str
    pattern: str
    nocase: bool = False
    group: int = 0
    least: int = 0


# -- expressions ---------------------------------------------------------------------------------------


def parse(pattern: str, nocase: bool = False):
    """A tree of ('set', bytes), ('cat', parts), ('alt', parts) and ('rep', part, least, most or None).

    Literals, escapes (\\xHH, \\. and the like), classes, groups, |, ?, *, + and {m}, {m,}, {m,n}.
    """
    p = pattern.encode("ascii")
    i = 0

    def fold(chars: set[int]) -> frozenset[int]:
        if nocase:
            chars = chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
        return frozenset(chars)

    def escaped() -> int:
        nonlocal i
        i += 1
        if p[i : i + 1] == b"x":
            i += 3
            return int(p[i - 2 : i], 16)
        i += 1
        return p[i - 1]

    def one_of() -> tuple:
        nonlocal i
        i += 1
        negated = p[i : i + 1] == b"^"
        i += negated
        chars: set[int] = set()
        while p[i : i + 1] != b"]":
            lo = escaped() if p[i : i + 1] == b"\\" else p[(i := i + 1) - 1]
            hi = lo
            if p[i : i + 1] == b"-" and p[i + 1 : i + 2] != b"]":
                i += 1
                hi = escaped() if p[i : i + 1] == b"\\" else p[(i := i + 1) - 1]
            chars |= set(range(lo, hi + 1))
        i += 1
        return ("set", frozenset(range(256)) - fold(chars) if negated else fold(chars))

    def atom():
        nonlocal i
        if p[i : i + 1] == b"(":
            i += 1
            inner = either()
            i += 1
            return inner
        if p[i : i + 1] == b"[":
            return one_of()
        if p[i : i + 1] == b"\\":
            return ("set", fold({escaped()}))
        i += 1
        return ("set", fold({p[i - 1]}))

    def repeated():
        nonlocal i
        part = atom()
        while i < len(p) and p[i : i + 1] in b"?*+{":
            c = p[i : i + 1]
            i += 1
            if c == b"{":
                end = p.index(b"}", i)
                lo, comma, hi = p[i:end].partition(b",")
                i = end + 1
                part = ("rep", part, int(lo), int(hi) if hi else None if comma else int(lo))
            else:
                part = ("rep", part, int(c == b"+"), 1 if c == b"?" else None)
        return part

    def row():
        parts = []
        while i < len(p) and p[i : i + 1] not in b"|)":
            parts.append(repeated())
        return ("cat", parts)

    def either():
        nonlocal i
        parts = [row()]
        while i < len(p) and p[i : i + 1] == b"|":
            i += 1
            parts.append(row())
        return ("alt", parts)

    tree = either()
    if i != len(p):
        raise ValueError(f"can't read {pattern!r} from {i}")
    return tree


def mirrored(tree):
    """The tree of the reversed words."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    parts = [mirrored(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


# -- automata ------------------------------------------------------------------------------------------


@dataclass
class Loose:
    """A nondeterministic automaton: moves on byte sets, and free moves."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, a: int) -> int:
        """Puts the tree after state a; the state after it."""
        kind = tree[0]
        if kind == "set":
            z = self.state()
            self.moves[a].append((tree[1], z))
            return z
        if kind == "cat":
            for x in tree[1]:
                a = self.add(x, a)
            return a
        if kind == "alt":
            z = self.state()
            for x in tree[1]:
                self.free[self.add(x, a)].append(z)
            return z
        _, part, least, most = tree
        for _ in range(least):
            a = self.add(part, a)
        if most is None:
            hub = self.state()
            self.free[a].append(hub)
            self.free[self.add(part, hub)].append(hub)
            z = self.state()
            self.free[hub].append(z)
            return z
        z = self.state()
        self.free[a].append(z)
        for _ in range(most - least):
            a = self.add(part, a)
            self.free[a].append(z)
        return z


@dataclass(frozen=True)
class Automaton:
    """Deterministic: state 0 starts; ``moves[state * classes + class_of[byte]]`` is the next state; bit r of
    ``accepts[state]``: rule r. ``dead`` is the state that nothing leaves, or -1."""

    class_of: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def classes(self) -> int:
        return int(self.class_of.max()) + 1


def byte_classes(sets: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Bytes that no set tells apart share a class; a byte of each class."""
    seen: dict[tuple, int] = {}
    class_of = np.zeros(256, dtype=np.int64)
    first = []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in seen:
            seen[key] = len(seen)
            first.append(b)
        class_of[b] = seen[key]
    return class_of, first


def build(trees: list, search: bool) -> Automaton:
    """Subset construction for the rules together. search: a match may start at any byte."""
    n = Loose()
    start = n.state()
    ends = {n.add(t, start): r for r, t in enumerate(trees)}
    sets = list(dict.fromkeys(s for m in n.moves for s, _ in m))
    class_of, first = byte_classes(sets)

    closures = {}

    def closed(states: frozenset[int]) -> frozenset[int]:
        if states not in closures:
            closures[states] = reached(states)
        return closures[states]

    def reached(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in n.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    # where each state leads on each class of bytes
    on = [[frozenset(z for chars, z in m if b in chars) for b in first] for m in n.moves]
    again = frozenset([start]) if search else frozenset()
    initial = closed(frozenset([start]))
    number, order, rows = {initial: 0}, [initial], []
    for states in order:
        row = []
        live = [on[s] for s in states if n.moves[s]]
        for c in range(len(first)):
            nxt = closed(again.union(*[x[c] for x in live]))
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    accepts = np.array([sum(1 << ends[s] for s in states if s in ends) for states in order], dtype=np.int64)
    return minimised(class_of, np.array(rows, dtype=np.int64), accepts)


def minimised(class_of: np.ndarray, rows: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merges states that no input tells apart: parts split by what they accept, then by where they lead."""
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    # states in the order in which they first occur, so the start is 0
    _, at = np.unique(part, return_index=True)
    order = np.argsort(at)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    part, keep = rank[part], at[order]
    moves, accepts = part[rows[keep]], accepts[keep]
    dead = [s for s in range(len(keep)) if accepts[s] == 0 and (moves[s] == s).all() and s]
    return Automaton(class_of, moves.reshape(-1), accepts, dead[0] if dead else -1)


@dataclass(frozen=True)
class Scanner:
    """The combined backward automaton and each rule's forward one."""

    rules: tuple[Rule, ...]
    back: Automaton
    ahead: tuple[Automaton, ...]


def compiled(rules: list[Rule]) -> Scanner:
    trees = [parse(r.pattern, r.nocase) for r in rules]
    return Scanner(tuple(rules), build([mirrored(t) for t in trees], search=True), tuple(build([t], search=False) for t in trees))
