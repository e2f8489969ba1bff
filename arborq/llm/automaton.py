"""One deterministic automaton for many byte regexes: parsing, subset construction, minimisation, transition arrays.

The regex subset: literals, classes, escapes (\\xHH, \\n, \\t, \\r, \\d, \\w, \\s, punctuation), groups, |, ? * + {m}
{m,} {m,n}, and (?i:...) for ASCII letters in either case. Rules match bytes; classes name ASCII only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}
DIGIT = frozenset(range(48, 58))
WORD = DIGIT | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
SPACE = frozenset({9, 10, 11, 12, 13, 32})
#: Rules that need more are refused rather than built for minutes.
MOST_STATES = 50_000
SHORT = {"d": DIGIT, "w": WORD, "s": SPACE}


class Parser:
    """Regex text to a tree: ("set", bytes), ("cat", parts), ("or", parts), ("repeat", part, low, high or None)."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def parse(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                bounds = (int(low), int(low) if "," not in self.text[self.at : end] else int(high) if high else None)
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = ("repeat", part, *bounds)
        return part

    def folded(self, chars: frozenset[int]) -> frozenset[int]:
        if not self.fold:
            return chars
        return chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}

    def escape(self) -> frozenset[int]:
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return frozenset({int(self.text[self.at - 2 : self.at], 16)})
        if c in SHORT:
            return SHORT[c]
        if c.isalnum() and c not in ESCAPES:
            raise ValueError(f"unknown escape \\{c}")
        return frozenset({ESCAPES.get(c, ord(c))})

    def atom(self):
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            was = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            self.at, self.fold = self.at + 1, was
            return tree
        if c == "[":
            return ("set", self.folded(self.members()))
        if c == "\\":
            return ("set", self.folded(self.escape()))
        if c == "." or ord(c) > 127:
            raise ValueError(f"{c!r} is not supported")
        return ("set", self.folded(frozenset({ord(c)})))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.at += negated
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            one = self.member()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                one = frozenset(range(min(one), max(self.member()) + 1))
            found |= one
        self.at += 1
        return frozenset(range(128)) - found if negated else frozenset(found)

    def member(self) -> frozenset[int]:
        c = self.text[self.at]
        self.at += 1
        return self.escape() if c == "\\" else frozenset({ord(c)})


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    return ("repeat", reverse(tree[1]), *tree[2:]) if kind == "repeat" else tree


@dataclass
class Nfa:
    """Thompson's construction."""

    empty: list[list[int]] = field(default_factory=list)
    moves: list[tuple[frozenset[int], int] | None] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds tree from start on; the state that it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            a = self.state()
            self.empty[start].append(a)
            self.moves[a] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                a = self.state()
                self.empty[start].append(a)
                self.empty[self.add(part, a)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Dfa:
    """Transition arrays. kind_of: byte to class (a translation table); step[state * n_kinds + class]: next state times
    n_kinds; states with accepts come last, from `accepting` on (already times n_kinds). dead: -1 or the state that
    nothing leaves."""

    kind_of: bytes
    n_kinds: int
    step: list[int]
    accepts: list[frozenset[int]]
    accepting: int
    start: int
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def build(trees: list, anywhere: bool) -> Dfa:
    """One automaton over all trees; accepts name the trees that match. anywhere: matches may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    ends = {nfa.add(tree, a): k for k, tree in enumerate(trees) for a in [nfa.state()] if not nfa.empty[root].append(a)}
    bounds: dict[tuple[bool, ...], int] = {}
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    kind_of = bytes(bounds.setdefault(tuple(b in s for s in sets), len(bounds)) for b in range(256))
    n_kinds = len(bounds)
    members = list(bounds)  # class number to which of sets it is in
    which = {s: i for i, s in enumerate(sets)}
    begin = nfa.closure([root])
    after = {  # state and class: the closed set of states that follow
        x: [nfa.closure([m[1]]) if members[kind][which[m[0]]] else frozenset() for kind in range(n_kinds)] for x, m in enumerate(nfa.moves) if m
    }
    kept = frozenset(after) | frozenset(ends)  # the others only pass on
    begin &= kept
    after = {x: [to & kept for to in row] for x, row in after.items()}
    base = begin if anywhere else frozenset()
    numbers, todo, table = {begin: 0}, [begin], []
    for states in todo:  # subset construction; todo grows meanwhile
        rows = [after[x] for x in states if x in after]
        row = []
        for kind in range(n_kinds):
            to = base.union(*(r[kind] for r in rows))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        table.append(row)
        if len(numbers) > MOST_STATES:
            raise ValueError(f"the rules need more than {MOST_STATES} states; move length bounds to keep")
    accepts = [frozenset(ends[x] for x in states if x in ends) for states in numbers]
    return minimised(table, accepts, kind_of, n_kinds)


def minimised(table: list[list[int]], accepts: list[frozenset[int]], kind_of: bytes, n_kinds: int) -> Dfa:
    """Moore's refinement: split blocks of states until all of a block go to the same blocks."""
    ids: dict = {}
    block = [ids.setdefault(a, len(ids)) for a in accepts]
    while True:
        ids = {}
        new = [ids.setdefault((block[i], *(block[t] for t in row)), len(ids)) for i, row in enumerate(table)]
        if len(ids) == len(set(block)):
            break
        block = new
    one_of = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(one_of, key=lambda b: (bool(accepts[one_of[b]]), one_of[b]))
    at = {b: i for i, b in enumerate(order)}
    rows = [[at[block[t]] for t in table[one_of[b]]] for b in order]
    tags = [accepts[one_of[b]] for b in order]
    accepting = next((i for i, a in enumerate(tags) if a), len(tags))
    dead = next((i for i, row in enumerate(rows) if not tags[i] and set(row) == {i}), -1)
    places = [k * n_kinds for k in range(len(rows))]  # one number object a state, not one an entry
    return Dfa(kind_of, n_kinds, [places[t] for row in rows for t in row], tags, accepting * n_kinds, at[block[0]] * n_kinds, dead * n_kinds if dead >= 0 else -1)
