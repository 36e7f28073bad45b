"""One deterministic automaton for many rules, and its scan over arrays of bytes.

Rules are regular expressions of a small kind: literals, ``\\xNN``, classes, groups,
alternation, ``? * +`` and ``{n}``. ``compile_rules`` joins them, each behind any prefix, builds
the deterministic states by subset construction over classes of equal bytes, merges
equivalent states (Moore's refinement) and returns plain arrays. A state's mask has bit ``i``
set when rule ``i`` ends there.

``scan`` runs the automaton over many pieces of text at once, one byte of each per step. A
text may be cut after every two bytes that lead all states to the start (``resets``), so
the pieces are short and independent, and every byte is looked at once for all rules. A rule
that ends in a repetition must be given three repeats at least; then no longer match of
it crosses a cut either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Builds fragments (start, end) of a nondeterministic automaton with empty moves."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def rule(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, fold
        made = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return made

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            start, end = self._sequence()
            self.empty[a].append(start)
            self.empty[end].append(b)
            if self._peek() != "|":
                return a, b
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self._peek() not in ("", "|", ")"):
            begun = self.at
            start, end = self._atom()
            stop, times, kind = self.at, 1, self._peek()
            if kind == "{":
                close = self.text.index("}", self.at)
                times, self.at = int(self.text[self.at + 1 : close]), close + 1
                stop_after = self.at
                for _ in range(times - 1):
                    self.at = begun
                    more, more_end = self._atom()
                    self.empty[end].append(more)
                    end = more_end
                self.at = stop_after
            elif kind in ("?", "*", "+"):
                self.at = stop + 1
                if kind != "?":
                    self.empty[end].append(start)
                if kind != "+":
                    skip = self.state()
                    self.empty[end].append(skip)
                    self.empty[start].append(skip)
                    end = skip
            self.empty[last].append(start)
            last = end
        return first, last

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 1
            inner = self._choice()
            if self._peek() != ")":
                raise ValueError(f"open group in {self.text!r}")
            self.at += 1
            a, b = self.state(), self.state()  # loops may hang on either
            self.empty[a].append(inner[0])
            self.empty[inner[1]].append(b)
            return a, b
        a, b = self.state(), self.state()
        self.moves[a].append((frozenset(self._bytes()), b))
        return a, b

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _bytes(self) -> set[int]:
        found = set()
        if self._peek() == "[":
            self.at += 1
            while self._peek() != "]":
                low = high = self._char()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._char()
                found.update(range(low, high + 1))
            self.at += 1
        else:
            found.add(self._char())
        if self.fold:
            found |= {ord(chr(c).swapcase()) for c in found if c < 128 and chr(c).isalpha()}
        return found


@dataclass(frozen=True)
class Automaton:
    """``step[state * width + kind[byte]]`` is the next state; 0 is the start. ``resets`` is
    indexed by the kinds of two bytes, the former times ``width``."""

    kind: np.ndarray
    width: int
    step: np.ndarray
    mask: np.ndarray
    resets: np.ndarray


def compile_rules(rules: list[tuple[str, bool]]) -> Automaton:
    """The automaton of ``(pattern, whether letters count in either case)``."""
    if len(rules) > 8:
        raise ValueError("a state's mask has room for 8 rules")
    parser = _Parser()
    ends, starts = {}, []
    for number, (pattern, fold) in enumerate(rules):
        start, end = parser.rule(pattern, fold)
        starts.append(start)
        ends[end] = 1 << number
    # Bytes that no rule tells apart are one kind.
    sets = sorted({tuple(sorted(s)) for moves in parser.moves for s, _ in moves})
    lookup = np.zeros((256, len(sets)), bool)
    for i, s in enumerate(sets):
        lookup[list(s), i] = True
    _, firsts, kind = np.unique(lookup, axis=0, return_index=True, return_inverse=True)
    width = len(firsts)

    def closed(states) -> frozenset[int]:
        found, work = set(states), list(states)
        while work:
            for nxt in parser.empty[work.pop()]:
                if nxt not in found:
                    found.add(nxt)
                    work.append(nxt)
        return frozenset(s for s in found if parser.moves[s] or s in ends)

    begin = closed(starts)
    moves = {s: [(frozenset(int(kind[b]) for b in on), nxt) for on, nxt in parser.moves[s]] for s in range(len(parser.moves))}
    known, order, table = {begin: 0}, [begin], []
    for states in order:  # grows while it is read
        targets: list[set[int]] = [set() for _ in range(width)]
        for s in states:
            for kinds, nxt in moves[s]:
                for k in kinds:
                    targets[k].add(nxt)
        row = []
        for goal in targets:
            after = begin if not goal else begin | closed(goal)
            if after not in known:
                known[after] = len(order)
                order.append(after)
            row.append(known[after])
        table.append(row)
    step = np.array(table)
    mask = np.array([sum({ends[s] for s in states if s in ends}) for states in order])
    # Equivalent states: same mask, and same classes after every kind of byte.
    group = np.unique(mask, return_inverse=True)[1]
    while True:
        key = np.column_stack([group, group[step]])
        finer = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    renamed = np.full(group.max() + 1, -1)
    place = 0
    for g in group:  # the start stays 0
        if renamed[g] < 0:
            renamed[g], place = place, place + 1
    group = renamed[group]
    _, one = np.unique(group, return_index=True)
    small = group[step[one]]
    resets = np.stack([(small[small[:, k]] == 0).all(axis=0) for k in range(width)])
    return Automaton(
        kind.reshape(-1).astype(np.int32),
        width,
        small.astype(np.int32).reshape(-1),
        mask[one].astype(np.uint8),
        resets.reshape(-1),
    )


#: Cuts are taken about this many bytes apart.
PIECE_BYTES = 64


def pieces(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the parts of a slice that the scan may take independently: cut where
    the automaton is at its start in any case, and at the borders of texts."""
    kinds = automaton.kind[data]
    cuts = np.flatnonzero(automaton.resets.take(kinds[:-1] * automaton.width + kinds[1:])) + 2
    if len(cuts):
        block = cuts // PIECE_BYTES
        cuts = cuts[np.append(True, block[1:] != block[:-1])]
    ends = np.union1d(cuts, offsets[1:])
    begins = np.append(0, ends[:-1])
    keep = ends > begins
    return begins[keep], ends[keep]


def scan(automaton: Automaton, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rules that end anywhere in each piece, as a mask."""
    if not len(begins):
        return np.zeros(0, np.uint8)
    lengths = ends - begins
    order = np.argsort(-lengths, kind="stable")
    at = begins[order]
    live = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), "right")
    kinds = automaton.kind[data]
    rows = np.zeros(len(order), np.int32)  # where the state's row begins
    found = np.zeros(len(order), np.uint8)
    for step, n in enumerate(live):
        s = automaton.step.take(rows[:n] + kinds.take(at[:n] + step))
        found[:n] |= automaton.mask.take(s)
        np.multiply(s, automaton.width, out=rows[:n])
    out = np.empty_like(found)
    out[order] = found
    return out
