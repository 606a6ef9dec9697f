"""One deterministic automaton for many byte patterns.

Patterns (literals, classes, groups, ``|``, ``? * +`` and ``{m,n}``) become an NFA, the NFA of
all rules together becomes a DFA by subset construction, and Moore's partition refinement
merges equal states. Tables are numpy arrays indexed by state and byte class.

Open tails (``[a-z]+`` at the end of a token) of many rules would multiply each other's states, and
counted repeats would be counted side by side. So a scan is made of heads: the bounded part
that every match of a rule begins with. Heads add up to little more than a trie.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

ANY_CASE = {b: {b, b ^ 32} for b in [*range(65, 91), *range(97, 123)]}


class _Parser:
    """Recursive descent over a pattern, into a tree of tuples."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self) -> tuple:
        tree = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return tree

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("then", parts)

    def repeated(self, tree: tuple) -> tuple:
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                low, comma, high = self.text[self.at : (end := self.text.index("}", self.at))].partition(",")
                self.at = end + 1
                low, high = int(low), int(high) if high else None if comma else int(low)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("times", tree, low, high)
        return tree

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.choice()
            self.take()
            return tree
        if c == "[":
            return ("bytes", self.charset())
        return ("bytes", self.cased({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def charset(self) -> frozenset:
        members, negated = set(), self.peek() == "^"
        if negated:
            self.take()
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.escape() if (d := self.take()) == "\\" else ord(d)
            members |= set(range(low, high + 1))
        members = set(self.cased(members))
        return frozenset(set(range(256)) - members if negated else members)

    def cased(self, members: set[int]) -> frozenset:
        return frozenset(x for b in members for x in (ANY_CASE.get(b, {b}) if self.any_case else {b}))


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Build ``tree`` from ``start``; the state it ends in."""
        kind = tree[0]
        if kind == "bytes":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "then":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "or":
            for option in tree[1]:
                self.empty[self.add(option, start)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


def _reversed(tree: tuple) -> tuple:
    kind = tree[0]
    if kind == "then":
        return ("then", [_reversed(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [_reversed(x) for x in tree[1]])
    if kind == "times":
        return ("times", _reversed(tree[1]), *tree[2:])
    return tree


#: Copies of a counted repeat in a head that already has LITERAL bytes, and without.
FEW_COPIES, MOST_COPIES, LITERAL = 4, 32, 3


def _width(tree: tuple) -> int:
    """The bytes that every match of ``tree`` has at least."""
    kind = tree[0]
    if kind == "bytes":
        return 1
    if kind == "then":
        return sum(map(_width, tree[1]))
    if kind == "or":
        return min(map(_width, tree[1]))
    return _width(tree[1]) * tree[2]


def _bounded(tree: tuple) -> bool:
    kind = tree[0]
    if kind == "bytes":
        return True
    if kind == "times":
        return tree[3] is not None and tree[3] <= FEW_COPIES and _bounded(tree[1])
    return all(map(_bounded, tree[1]))


def head_of(tree: tuple, least: int = 0) -> tuple:
    """A bounded tree that a prefix of every match of ``tree`` (of ``least`` bytes or more) matches."""
    parts = tree[1] if tree[0] == "then" else [tree]
    out: list[tuple] = []
    for k, part in enumerate(parts):
        if _bounded(part):
            out.append(part)
            continue
        if part[0] == "times" and _bounded(part[1]):
            have = sum(map(_width, out))
            low = part[2]
            if k == len(parts) - 1 and part[1][0] == "bytes" and have == sum(_width(x) for x in parts[:k]):
                low = max(low, least - have) if all(x[0] == "bytes" for x in parts[:k]) else low
            low = min(low, FEW_COPIES if have >= LITERAL else MOST_COPIES)
            if low:
                out.append(("times", part[1], low, low))
        elif part[0] in ("then", "or") and not out:
            out.append(head_of(part) if part[0] == "then" else ("or", [head_of(x) for x in part[1]]))
        break
    return ("then", out)


@dataclass(frozen=True)
class Dfa:
    """``step[state * n_classes + byte_class[byte]]`` is the next state; ``accept[state]`` is the number
    of a set of rules in ``ends``, and set 0 is empty. State 0 is where a scan starts."""

    step: np.ndarray
    byte_class: np.ndarray
    accept: np.ndarray
    dead: int
    ends: tuple[tuple[int, ...], ...]

    @property
    def n_classes(self) -> int:
        return int(self.byte_class.max()) + 1


class TooManyStates(ValueError):
    """The subset construction found more states than it was allowed."""


def tree_of(pattern: str, any_case: bool = False) -> tuple:
    return _Parser(pattern, any_case).parse()


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool, backward: bool = False) -> Dfa:
    """A minimal DFA over all ``patterns`` (pattern, any_case); see compile_trees."""
    return compile_trees([tree_of(*p) for p in patterns], anywhere, backward)


def compile_trees(trees: list[tuple], anywhere: bool, backward: bool = False, most_states: int = 1 << 20) -> Dfa:
    """A minimal DFA over all ``trees``.

    ``anywhere`` lets a match begin at any byte; ``backward`` reads the bytes from their end.
    """
    nfa, ends = _Nfa(), {}
    start = nfa.state()
    for rule, tree in enumerate(trees):
        own = nfa.state()
        nfa.empty[start].append(own)
        ends[nfa.add(_reversed(tree) if backward else tree, own)] = rule
    byte_class, members = _byte_classes(nfa)
    first = nfa.closure([start])
    always = first if anywhere else frozenset()
    # Sets of NFA states are bit masks; a state's moves by byte class already hold their closure.
    reach = [sum(1 << x for x in nfa.closure([s])) for s in range(len(nfa.moves))]
    moves = [[(k, reach[to]) for chars, to in own for k, byte in enumerate(members) if byte in chars] for own in nfa.moves]
    again, begin = sum(1 << x for x in always), sum(1 << x for x in first)
    # The moves of the states that are always there are the same in every set: taken once.
    base = [again] * len(members)
    for x in always:
        for k, mask in moves[x]:
            base[k] |= mask
    numbers, todo, table = {begin: 0}, [begin], []
    for states in todo:  # grows as new sets are found
        row = list(base)
        states &= ~again
        while states:
            low = states & -states
            for k, mask in moves[low.bit_length() - 1]:
                row[k] |= mask
            states ^= low
        for after in row:
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
        if len(numbers) > most_states:
            raise TooManyStates(f"more than {most_states} states")
        table.append([numbers[after] for after in row])
    final = sum(1 << end for end in ends)
    sets: dict[tuple[int, ...], int] = {(): 0}
    accept = [sets.setdefault(tuple(rule for end, rule in ends.items() if states >> end & 1) if states & final else (), len(sets)) for states in numbers]
    return _minimised(np.array(table), np.array(accept), byte_class, tuple(sets))


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that no class in the patterns tells apart share a number; one member of each."""
    sets = {chars for moves in nfa.moves for chars, _ in moves}
    by_sign: dict[tuple, list[int]] = defaultdict(list)
    for byte in range(256):
        by_sign[tuple(byte in chars for chars in sets)].append(byte)
    byte_class = np.zeros(256, np.int32)
    for number, members in enumerate(by_sign.values()):
        byte_class[members] = number
    return byte_class, [members[0] for members in by_sign.values()]


def _minimised(table: np.ndarray, accept: np.ndarray, byte_class: np.ndarray, ends: tuple[tuple[int, ...], ...]) -> Dfa:
    """Moore's refinement: states part where they accept differently, then where their moves do."""
    part = np.unique(accept, return_inverse=True)[1]
    while True:
        numbers: dict[bytes, int] = {}
        rows = np.ascontiguousarray(np.column_stack([part, part[table]]).astype(np.int32))
        finer = np.array([numbers.setdefault(row.tobytes(), len(numbers)) for row in rows])
        if len(numbers) == part.max() + 1:
            break
        part = finer
    # Number the parts as their first states come, so that the start stays 0.
    firsts = np.full(part.max() + 1, len(part))
    np.minimum.at(firsts, part, np.arange(len(part)))
    number = np.argsort(np.argsort(firsts))
    keep = np.sort(firsts)
    step = number[part[table[keep]]]
    own = np.arange(len(keep))
    dead = np.flatnonzero((step == own[:, None]).all(axis=1) & (accept[keep] == 0))
    return Dfa(step.astype(np.int32).ravel(), byte_class, accept[keep].astype(np.int32), int(dead[0]) if len(dead) else -1, ends)
