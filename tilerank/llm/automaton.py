"""Byte-level regular expressions as deterministic automata.

Rules are written in a small regex language over ASCII: literals, classes, groups,
alternation and the repeats ``? * + {m} {m,} {m,n}``. They are compiled by Thompson's
construction, determinised together by subset construction and minimised by partition
refinement, into arrays of transitions over classes of bytes that no rule tells apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_CLASSES = {
    "d": frozenset(range(0x30, 0x3A)),
    "w": frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F]),
    "s": frozenset([0x20, *range(0x09, 0x0E)]),
}


class _Nfa:
    """Thompson automaton: per state, empty moves and at most one move by a set of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.empty[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)


class _Parser:
    """Recursive descent; each piece becomes a tree of tuples, built into a _Nfa later."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self._either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return tree

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self):
        parts = [self._row()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._row())
        return ("either", parts) if len(parts) > 1 else parts[0]

    def _row(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("row", parts)

    def _repeated(self):
        piece = self._piece()
        while self._peek() and self._peek() in "?*+{":
            sign = self._peek()
            self.at += 1
            if sign == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                most = None if "," in self.text[self.at : end] and not high else int(high or low)
                self.at, piece = end + 1, ("repeat", piece, int(low), most)
            else:
                piece = ("repeat", piece, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[sign])
        return piece

    def _bytes(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            found = found | {b ^ 0x20 for b in found if chr(b & 0xDF).isalpha() and b < 0x80}
        return frozenset(found)

    def _escape(self) -> frozenset[int]:
        sign = self._peek()
        self.at += 1
        if sign in _CLASSES:
            return _CLASSES[sign]
        if sign == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        return frozenset([{"n": 10, "r": 13, "t": 9}.get(sign, ord(sign))])

    def _piece(self):
        sign = self._peek()
        self.at += 1
        if sign == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self._either()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.at += 1
            return tree
        if sign == "[":
            return ("bytes", self._set())
        if sign == ".":
            return ("bytes", frozenset(range(256)) - {10})
        if sign == "\\":
            return ("bytes", self._bytes(set(self._escape())))
        if not sign.isascii():
            raise ValueError(f"rules are ASCII only: {self.text!r}")
        return ("bytes", self._bytes({ord(sign)}))

    def _set(self) -> frozenset[int]:
        found: set[int] = set()
        negated = self._peek() == "^"
        self.at += negated
        while self._peek() != "]":
            sign = self._peek()
            self.at += 1
            low = self._escape() if sign == "\\" else frozenset([ord(sign)])
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]" and len(low) == 1:
                end = self.text[self.at + 1]
                self.at += 2
                low = frozenset(range(min(low), ord(end) + 1))
            found |= low
        self.at += 1
        return frozenset(range(256)) - self._bytes(found) if negated else self._bytes(found)


def _build(nfa: _Nfa, tree, start: int) -> int:
    """Add ``tree`` after state ``start``; the state it ends in."""
    kind = tree[0]
    if kind == "bytes":
        end = nfa.state()
        middle = nfa.state()
        nfa.empty[start].append(middle)
        nfa.move[middle] = (tree[1], end)
        return end
    if kind == "row":
        for part in tree[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "either":
        end = nfa.state()
        for part in tree[1]:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[_build(nfa, part, first)].append(end)
        return end
    _, piece, low, high = tree
    for _ in range(low):
        start = _build(nfa, piece, start)
    if high is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[_build(nfa, piece, loop)].append(loop)
        end = nfa.state()
        nfa.empty[loop].append(end)
        return end
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(high - low):
        start = _build(nfa, piece, start)
        nfa.empty[start].append(end)
    return end


@dataclass
class Automaton:
    """``moves[state * width + classes[byte]]`` is the next state times ``width``.

    States whose number times width is at least ``telling`` are those with a set bit in
    ``marks``: bit r says that rule r is matched. State ``dead`` (-1: none) leads nowhere.
    """

    classes: bytes
    width: int
    moves: list[int]
    start: int
    telling: int
    marks: list[int]
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.marks)


def _determinise(nfa: _Nfa, entry: frozenset[int], marks_of, again: bool) -> Automaton:
    sets = [move[0] for move in nfa.move if move]
    # Bytes that no rule tells apart share a class.
    groups: dict[tuple[int, ...], int] = {}
    member = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    classes = bytearray(256)
    sample: list[int] = []
    for byte in range(256):
        key = tuple(i for s, i in member.items() if byte in s)
        if key not in groups:
            groups[key] = len(groups)
            sample.append(byte)
        classes[byte] = groups[key]
    width = len(groups)
    numbers, order, rows = {entry: 0}, [entry], []
    for states in order:
        row = []
        movers = [nfa.move[s] for s in states if nfa.move[s]]
        for byte in sample:
            after = [end for accepted, end in movers if byte in accepted]
            target = nfa.closure(after) | entry if again else nfa.closure(after)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
    moves = np.array(rows, dtype=np.int64)
    marks = np.array([marks_of(states) for states in order], dtype=np.int64)

    # Minimisation: split blocks by where their states lead until no block splits.
    _, block = np.unique(marks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # One state per block, those with marks last.
    _, first = np.unique(block, return_index=True)
    place = np.argsort(marks[first] != 0, kind="stable")
    rank = np.empty(len(place), dtype=np.int64)
    rank[place] = np.arange(len(place))
    chosen = first[place]
    small = rank[block[moves[chosen]]]
    kept = marks[chosen]
    loops = np.flatnonzero((small == np.arange(len(chosen))[:, None]).all(axis=1) & (kept == 0))
    return Automaton(
        bytes(classes),
        width,
        (small * width).reshape(-1).tolist(),
        int(rank[block[0]]) * width,
        int((kept == 0).sum()) * width,
        kept.tolist(),
        int(loops[0]) * width if len(loops) and not again else -1,
    )


def _trees(rules: list[tuple[str, bool]]):
    return [_Parser(pattern, any_case).parse() for pattern, any_case in rules]


def search_automaton(rules: list[tuple[str, bool]]) -> Automaton:
    """All rules at once, beginning anew at each byte: a mark where a match may end."""
    nfa = _Nfa()
    begin = nfa.state()
    ends = {}
    for number, tree in enumerate(_trees(rules)):
        first = nfa.state()
        nfa.empty[begin].append(first)
        ends[_build(nfa, tree, first)] = 1 << number
    return _determinise(
        nfa, nfa.closure([begin]), lambda states: sum({ends[s] for s in states if s in ends}), True
    )


def match_automaton(rule: tuple[str, bool]) -> Automaton:
    """One rule, from where it is started."""
    nfa = _Nfa()
    begin = nfa.state()
    end = _build(nfa, _trees([rule])[0], begin)
    return _determinise(nfa, nfa.closure([begin]), lambda states: int(end in states), False)


def origin_automaton(rule: tuple[str, bool]) -> Automaton:
    """Read backwards from any point inside a match: a mark where the match may have begun."""
    nfa = _Nfa()
    begin = nfa.state()
    end = _build(nfa, _trees([rule])[0], begin)
    back = _Nfa()
    for _ in range(len(nfa.move)):
        back.state()
    for state, afters in enumerate(nfa.empty):
        for after in afters:
            back.empty[after].append(state)
    # A state may be entered by one byte move only, as built above.
    for state, move in enumerate(nfa.move):
        if move:
            back.move[move[1]] = (move[0], state)
    useful = back.closure([end])
    grown = True
    while grown:
        after = useful | back.closure([back.move[s][1] for s in useful if back.move[s]])
        grown, useful = len(after) > len(useful), after
    return _determinise(back, useful, lambda states: int(begin in states), False)
