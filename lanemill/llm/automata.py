"""Rule regexes compiled to one minimal deterministic automaton over bytes.

The grammar covers literals, escapes, character classes, groups with alternatives and the
repeats ``? * + {n} {n,} {n,m}``. A rule set becomes one nondeterministic automaton in which
every rule may begin at every byte; subset construction and partition refinement turn it into
transition arrays that find the ends of all rules' matches in one pass over the bytes. A second
automaton per rule runs backwards from an end to its leftmost start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain
from operator import getitem, itemgetter

import numpy as np

_FINAL = re.compile(rb"[^\x00]")


@dataclass(frozen=True)
class Rule:
    """A secret's kind and pattern; matches below ``min_length`` are consumed and dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_length: int = 0


# --- parsing -------------------------------------------------------------------------------

_ESCAPES = {"n": 10, "r": 13, "t": 9, "d": None, "w": None}
_DIGITS = frozenset(range(48, 58))
_WORDS = frozenset([*_DIGITS, *range(65, 91), *range(97, 123), 95])


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def repeat(self, atom):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                body = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(body) + 1
                low, comma, high = body.partition(",")
                bounds = (int(low), int(high) if high else None if comma else int(low))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("rep", atom, *bounds)
        return atom

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            inside = self.either()
            if self.take() != ")":
                raise ValueError(f"group not closed: {self.p}")
            return inside
        if c == "[":
            return self.byte_class()
        if c == "\\":
            return ("set", self.folded(self.escape()))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({ord(c)}))

    def escape(self) -> frozenset:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset({int(self.p[self.i - 2 : self.i], 16)})
        if c in "dw":
            return _DIGITS if c == "d" else _WORDS
        return frozenset({_ESCAPES.get(c, ord(c))})

    def byte_class(self):
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            one = self.escape() if c == "\\" else frozenset({ord(c)})
            if self.peek() == "-" and self.p[self.i + 1] != "]" and len(one) == 1:
                self.take()
                c = self.take()
                end = self.escape() if c == "\\" else {ord(c)}
                one = frozenset(range(min(one), max(end) + 1))
            found |= one
        self.take()
        found = set(self.folded(found))
        return ("set", frozenset(range(256)) - found if negated else frozenset(found))

    def folded(self, found) -> frozenset:
        if not self.fold:
            return frozenset(found)
        return frozenset(x for b in found for x in (*chr(b).lower().encode("latin-1"), *chr(b).upper().encode("latin-1")))


def parse(rule: Rule):
    parser = _Parser(rule.pattern, rule.ignore_case)
    tree = parser.either()
    if parser.i != len(rule.pattern):
        raise ValueError(f"unexpected ')' in {rule.pattern}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "seq":
        return ("seq", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


# --- automata ------------------------------------------------------------------------------


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        """Add ``tree`` after ``start``; returns its last state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            here = self.state()
            self.empty[start].append(here)
            self.step[here] = (tree[1], end)
            return end
        if kind == "seq":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.build(part, begin)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.build(inner, start)
        end = self.state()
        self.empty[start].append(end)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            last = self.build(inner, loop)
            self.empty[last] += [loop, end]
        else:
            for _ in range(high - low):
                start = self.build(inner, start)
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


@dataclass
class Dfa:
    """``table[state * n_classes + classes[byte]]`` is the next state; states from ``first_final``
    on accept, ``accepts[state]`` lists the rules; state ``dead`` (or -1) never accepts again."""

    classes: bytes
    n_classes: int
    table: np.ndarray
    start: int
    first_final: int
    accepts: list[tuple[int, ...]]
    dead: int


def compile_dfa(trees: list, anchored: bool) -> Dfa:
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.build(tree, begin)] = k
    # Bytes that no rule tells apart share a class.
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    signatures: dict[tuple, int] = {}
    classes = bytes(signatures.setdefault(tuple(b in s for s in sets), len(signatures)) for b in range(256))
    sample = [classes.index(k) for k in range(len(signatures))]
    # Subset construction; the empty-step closures of all targets are taken once.
    start = nfa.closure([root])
    begin = start if not anchored else frozenset()
    after_step = {s: (step[0], nfa.closure([step[1]])) for s, step in enumerate(nfa.step) if step}
    moves = {s: [(k, to) for k, b in enumerate(sample) if b in on] for s, (on, to) in after_step.items()}
    number, rows, todo = {start: 0}, [], [start]
    for now in todo:
        reached: list[set] = [set(begin) for _ in sample]
        for s in now:
            for k, to in moves.get(s, ()):
                reached[k] |= to
        row = []
        for states in reached:
            after = frozenset(states)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    accepts = [tuple(sorted(ends[s] for s in states if s in ends)) for states in number]
    return _minimise(np.array(rows, np.int32), accepts, classes, len(sample))


def _minimise(table: np.ndarray, accepts: list[tuple], classes: bytes, n: int) -> Dfa:
    """Partition refinement: states split until equal states agree on every next block."""
    kinds: dict[tuple, int] = {}
    block = np.array([kinds.setdefault(a, len(kinds)) for a in accepts], np.int32)
    while True:
        _, fresh = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        fresh = fresh.reshape(-1).astype(np.int32)
        if fresh.max() == block.max():
            break
        block = fresh
    size = int(block.max()) + 1
    one = np.zeros(size, np.int64)
    one[block] = np.arange(len(block))
    finals = [bool(accepts[one[k]]) for k in range(size)]
    order = sorted(range(size), key=lambda k: (finals[k], k))
    place = np.empty(size, np.int32)
    place[order] = np.arange(size)
    small = np.array([place[block[table[one[k]]]] for k in order], np.int32)
    dead = next((s for s in range(size) if not finals[order[s]] and (small[s] == s).all()), -1)
    return Dfa(classes, n, small, int(place[block[0]]), size - sum(finals), [accepts[one[k]] for k in order], dead)


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], Dfa, list[Dfa]]:
    """The automaton of all rules and each rule's backward automaton, as plain arrays."""
    trees = [parse(r) for r in rules]
    return rules, compile_dfa(trees, anchored=False), [compile_dfa([reverse(t)], anchored=True) for t in trees]


class Scanner:
    """All rules in one pass over a text's bytes."""

    def __init__(self, rules: tuple[Rule, ...], dfa: Dfa, back: list[Dfa]):
        self.rules, self.dfa, self.back = rules, dfa, back
        # A state is the list of its next states by byte class, with the number of its set of rules last.
        self.sets = sorted({a for a in self.dfa.accepts})
        self.sets.sort(key=len)  # the empty set is number 0
        nodes: list[list] = [[] for _ in self.dfa.accepts]
        for node, row, rules in zip(nodes, self.dfa.table.tolist(), self.dfa.accepts, strict=True):
            node.extend(nodes[s] for s in row)
            node.append(self.sets.index(rules))
        self.begin, self.set_of = nodes[self.dfa.start], itemgetter(self.dfa.n_classes)
        self.back_rows = [b.table.tolist() for b in self.back]

    def leftmost(self, k: int, data: bytes, low: int, end: int) -> int:
        """Leftmost start from ``low`` on of a match of rule ``k`` that ends at ``end``; -1: none."""
        dfa, rows = self.back[k], self.back_rows[k]
        state, found, classes = dfa.start, -1, dfa.classes
        for i in range(end - 1, low - 1, -1):
            state = rows[state][classes[data[i]]]
            if state == dfa.dead:
                break
            if state >= dfa.first_final:
                found = i
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, leftmost and non-overlapping for each rule."""
        walked = accumulate(chain((self.begin,), data.translate(self.dfa.classes)), getitem)
        sets = bytes(map(self.set_of, walked))  # of the state before each byte, and after the last
        hits = [(m.start() - 1, sets[m.start()]) for m in _FINAL.finditer(sets)]
        if not hits:
            return []
        last_at: dict[int, int] = {}  # of each rule, the last byte at which it accepted
        ends: list[tuple[int, int]] = []
        for i, s in hits:
            for k in self.sets[s]:
                if last_at.get(k, i) < i - 1:
                    ends.append((last_at[k] + 1, k))
                last_at[k] = i
        ends += [(i + 1, k) for k, i in last_at.items()]
        found, free = [], [0] * len(self.rules)
        for end, k in sorted(ends):
            start = self.leftmost(k, data, free[k], end)
            if start >= 0:
                free[k] = end
                if end - start >= self.rules[k].min_length:
                    found.append((start, k, end))
        return sorted(found)
