"""Rules for character sequences, compiled into one deterministic automaton over bytes.

Each rule is first turned into an automaton of its own that finds leftmost, longest, non-overlapping matches: subset
construction over groups of states, one group for each place where a match may have begun, the earliest first. The
product of these automata, with equal states merged, reads every byte once for all rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


#: A rule without a head is only reported after so many bytes of its class; the rest of its length is counted outside.
PROBE = 6


@dataclass(frozen=True)
class Rule:
    """`head` followed by one or more bytes of the class `tail`; a match counts if the tail has `least` bytes or more.

    A match that counts goes on with `rest`, a regular expression for what stands behind it; the next match begins after it.
    """

    kind: str
    head: str
    tail: str
    least: int
    rest: str = ""

    @property
    def probe(self) -> int:
        return 1 if self.head else min(self.least, PROBE)


class Nfa:
    """States 0..n-1 with empty moves and moves by sets of bytes; built from a small regular-expression language.

    Literals, escapes (`\\x20`, `\\.`), classes with ranges, groups, `(?i:...)`, `|`, `?`, `*`, `+`, `{n}` and `{n,}`.
    """

    def __init__(self, pattern: str):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.text, self.at = pattern, 0
        self.start, self.accept = self._choice(False)
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def _peek(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def _take(self, what: str) -> bool:
        found = self._peek(what)
        self.at += len(what) * found
        return found

    def _choice(self, fold: bool) -> tuple[int, int]:
        parts = [self._sequence(fold)]
        while self._take("|"):
            parts.append(self._sequence(fold))
        if len(parts) == 1:
            return parts[0]
        first, last = self._state(), self._state()
        for begin, end in parts:
            self.empty[first].append(begin)
            self.empty[end].append(last)
        return first, last

    def _sequence(self, fold: bool) -> tuple[int, int]:
        first = last = self._state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            place = self.at
            begin, end = self._quantified(self._atom(fold), place, fold)
            self.empty[last].append(begin)
            last = end
        return first, last

    def _atom(self, fold: bool) -> tuple[int, int]:
        if self._take("("):
            inner = fold or self._take("?i:")
            self._take("?:")
            part = self._choice(inner)
            if not self._take(")"):
                raise ValueError(f"unclosed group in {self.text!r}")
            return part
        first, last = self._state(), self._state()
        self.moves[first].append((self._bytes(fold), last))
        return first, last

    def _char(self) -> str:
        char = self.text[self.at]
        self.at += 1
        if char != "\\":
            return char
        char = self.text[self.at]
        self.at += 1
        if char == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        return char

    def _bytes(self, fold: bool) -> frozenset[int]:
        chars = set()
        if self._take("["):
            while not self._take("]"):
                low = high = self._char()
                if self._peek("-") and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._char()
                chars |= {chr(c) for c in range(ord(low), ord(high) + 1)}
        else:
            chars = {self._char()}
        if fold:
            chars |= {c.lower() for c in chars} | {c.upper() for c in chars}
        if any(ord(c) > 127 for c in chars):
            raise ValueError("only ASCII characters can be named")
        return frozenset(map(ord, chars))

    def _quantified(self, part: tuple[int, int], place: int, fold: bool) -> tuple[int, int]:
        begin, end = part
        if self._take("{"):
            low, _, high = self.text[self.at : self.text.index("}", self.at)].partition(",")
            open_ended = self.text[self.text.index("}", self.at) - 1] == ","
            if high:
                raise ValueError("an upper limit is not supported")
            self.at = after = self.text.index("}", self.at) + 1
            for k in range(int(low) - 1 + open_ended):
                self.at = place
                more_begin, more_end = self._atom(fold)
                if open_ended and k == int(low) - 1:
                    self.empty[more_begin].append(more_end)
                    self.empty[more_end].append(more_begin)
                self.empty[end].append(more_begin)
                end = more_end
            self.at = after
        elif self._take("?"):
            self.empty[begin].append(end)
        elif self._take("*"):
            self.empty[begin].append(end)
            self.empty[end].append(begin)
        elif self._take("+"):
            self.empty[end].append(begin)
        return begin, end

    def closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for state in self.empty[todo.pop()]:
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return frozenset(found)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for s in states for chars, to in self.moves[s] if byte in chars})

    def reversed(self) -> Nfa:
        other = object.__new__(Nfa)
        other.empty, other.moves = [[] for _ in self.empty], [[] for _ in self.moves]
        for state, targets in enumerate(self.empty):
            for to in targets:
                other.empty[to].append(state)
        for state, moves in enumerate(self.moves):
            for chars, to in moves:
                other.moves[to].append((chars, state))
        other.start, other.accept = self.accept, self.start
        return other


def byte_classes(nfas: list[Nfa]) -> tuple[list[int], list[int]]:
    """A class for each byte, so that no rule tells the bytes of a class apart; and one byte of each class."""
    sets = {chars for nfa in nfas for moves in nfa.moves for chars, _ in moves}
    seen: dict[tuple[bool, ...], int] = {}
    classes = [seen.setdefault(tuple(byte in chars for chars in sets), len(seen)) for byte in range(256)]
    return classes, [classes.index(c) for c in range(len(seen))]


class Leftmost:
    """The leftmost, longest matches of one rule; begun and ended matches are reported as they are seen."""

    def __init__(self, nfa: Nfa):
        self.nfa = nfa
        self.first = nfa.closure({nfa.start})
        self.fresh = ((), False)

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool, bool]:
        """The next state, whether a match has just begun its tail, and whether one ended before this byte."""
        groups, matched = state
        found: list[frozenset[int]] = []
        seen: set[int] = set()
        for group in groups if matched else (*groups, self.first):
            if new := self.nfa.step(group, byte) - seen:
                accepts = self.nfa.accept in new
                if (accepts and found) or (matched and not accepts):
                    raise ValueError("a rule's matches must be told apart in one pass")
                found.append(frozenset(new))
                seen |= new
                if accepts:
                    return (tuple(found), True), not matched, False
        if matched and not found:
            after, begun, _ = self.step(self.fresh, byte)
            return after, begun, True
        return (tuple(found), matched), False, False


@dataclass(frozen=True)
class Automaton:
    """`table[state * 256 + byte]` is the next state times 256; from `events` on, states report matches.

    `begun` and `ended` hold the rules that a reporting state reports, `open_at_end` those with a match in each state.
    """

    rules: tuple[Rule, ...]
    table: list[int]
    events: int
    begun: dict[int, tuple[int, ...]]
    ended: dict[int, tuple[int, ...]]
    open_at_end: list[tuple[int, ...]]
    heads: tuple[tuple[list[list[int]], frozenset[int]] | None, ...]

    def spans(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) in bytes of each match that counts, those of a rule in order."""
        table, events = self.table, self.events
        tails = [0] * len(self.rules)
        floors = [0] * len(self.rules)
        state = 0
        for place, byte in enumerate(data):
            state = table[state + byte]
            if state >= events:
                for rule in self.ended.get(state, ()):
                    yield from self._span(data, rule, tails[rule], place, floors)
                for rule in self.begun.get(state, ()):
                    tails[rule] = place
        for rule in self.open_at_end[state >> 8]:
            yield from self._span(data, rule, tails[rule], len(data), floors)

    def _span(self, data: bytes, rule: int, tail: int, end: int, floors: list[int]) -> Iterator[tuple[int, int, int]]:
        floor, floors[rule] = floors[rule], max(end, floors[rule])
        tail -= self.rules[rule].probe - 1
        if end - tail < self.rules[rule].least or tail < floor:
            return
        if self.rules[rule].rest and (more := re.compile(self.rules[rule].rest.encode()).match(data, end)):
            end = floors[rule] = more.end()
        if self.heads[rule] is None:
            yield rule, tail, end
        else:
            moves, accepting = self.heads[rule]
            state, start, place = 0, tail, tail
            while place > floor and (state := moves[state][data[place - 1]]) >= 0:
                place -= 1
                if state in accepting:
                    start = place
            yield rule, start, end


def _backward(head: str) -> tuple[list[list[int]], frozenset[int]]:
    """Reads a head from its end; -1: no head ends here with these bytes."""
    nfa = Nfa(head).reversed()
    states = {nfa.closure({nfa.start}): 0}
    rows, todo = [], [next(iter(states))]
    while todo:
        state = todo.pop(0)
        targets = [nfa.step(state, byte) for byte in range(256)]
        for target in targets:
            if target and target not in states:
                states[target] = len(states)
                todo.append(target)
        rows.append([states[t] if t else -1 for t in targets])
    return rows, frozenset(number for state, number in states.items() if nfa.accept in state)


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """One automaton for all rules: subset construction of each, their product, and merging of equal states."""
    nfas = [Nfa(f"{r.head}{r.tail}{{{r.probe},}}") for r in rules]
    classes, samples = byte_classes(nfas)
    parts = [Leftmost(nfa) for nfa in nfas]
    known: list[dict] = [{} for _ in parts]
    numbers: list[dict] = [{p.fresh: 0} for p in parts]
    open_in: list[list[bool]] = [[False] for _ in parts]

    def one(part: int, state: tuple, byte: int) -> tuple[tuple, bool, bool]:
        if (state, byte) not in known[part]:
            after, begun, ended = parts[part].step(state, byte)
            if after not in numbers[part]:
                numbers[part][after] = len(numbers[part])
                open_in[part].append(after[1])
            known[part][state, byte] = after, begun, ended
        return known[part][state, byte]

    start = (tuple(p.fresh for p in parts), (), ())
    states, rows, todo = {start: 0}, [], [start]
    for state in todo:
        row = []
        for byte in samples:
            steps = [one(part, own, byte) for part, own in enumerate(state[0])]
            after = (
                tuple(s[0] for s in steps),
                tuple(k for k, s in enumerate(steps) if s[1]),
                tuple(k for k, s in enumerate(steps) if s[2]),
            )
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            row.append(states[after])
        rows.append(row)
    opened = [tuple(k for k, own in enumerate(s[0]) if open_in[k][numbers[k][own]]) for s in states]
    reports = [(s[1], s[2], o) for s, o in zip(states, opened, strict=True)]
    blocks = _merge(np.array(rows), reports)

    # blocks that report matches come last, the block of the start first
    order = sorted(set(blocks), key=lambda b: (bool(reports[blocks.index(b)][0] or reports[blocks.index(b)][1]), b != blocks[0]))
    number = {block: 256 * place for place, block in enumerate(order)}
    firsts = [blocks.index(block) for block in order]
    table = [number[blocks[rows[first][classes[byte]]]] for first in firsts for byte in range(256)]
    begun = {256 * place: reports[first][0] for place, first in enumerate(firsts) if reports[first][0]}
    ended = {256 * place: reports[first][1] for place, first in enumerate(firsts) if reports[first][1]}
    return Automaton(
        rules,
        table,
        min([*begun, *ended], default=len(table)),
        begun,
        ended,
        [reports[first][2] for first in firsts],
        tuple(_backward(r.head) if r.head else None for r in rules),
    )


def _merge(rows: np.ndarray, reports: list[tuple]) -> list[int]:
    """Equal numbers for states that no input tells apart: blocks are split until their moves agree."""
    seen: dict[tuple, int] = {}
    blocks = np.array([seen.setdefault(report, len(seen)) for report in reports])
    while True:
        _, finer = np.unique(np.column_stack([blocks, blocks[rows]]), axis=0, return_inverse=True)
        if finer.max() == blocks.max():
            return blocks.tolist()
        blocks = finer.ravel()
