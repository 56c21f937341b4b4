"""Several patterns as one deterministic automaton, whose states are made when a text first needs them."""

from __future__ import annotations

import re
from itertools import product

_COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}|[?*+]")
_COUNTS = {"?": (0, 1), "*": (0, None), "+": (1, None)}
#: Classes with more letters than this end the fixed head of a pattern.
HEAD_CLASS = 8
#: A transition table beyond this size is begun anew (long patterns have many states).
MOST_MOVES = 2_000_000
DEAD = 0


def parse(pattern: str, at: int = 0):
    """(alternatives, end): each a list of (piece, least, most); a piece is a one-letter pattern or alternatives of its own.

    Takes literals, escapes, classes, groups, ``|`` and counts: what formats of tokens need.
    """
    alternatives, row = [], []
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            alternatives.append(row)
            row, at = [], at + 1
            continue
        if pattern.startswith("(?:", at):
            piece, at = parse(pattern, at + 3)
            at += 1
        elif pattern[at] == "[":
            end = pattern.index("]", at + 2) + 1
            piece, at = pattern[at:end], end
        elif pattern[at] == "\\":
            piece, at = pattern[at : at + 2], at + 2
        else:
            piece, at = re.escape(pattern[at]), at + 1
        least, most = 1, 1
        count = _COUNT.match(pattern, at)
        if count:
            at = count.end()
            if count[1] is None:
                least, most = _COUNTS[count[0]]
            else:
                least = int(count[1])
                most = (int(count[3]) if count[3] else None) if count[2] else least
        row.append((piece, least, most))
    return [*alternatives, row], at


def _letters(piece: str) -> list[str]:
    one = re.compile(piece, re.ASCII)
    return [c for c in map(chr, range(32, 127)) if one.match(c)]


def heads(alternatives) -> list[tuple[str, bool]]:
    """(text, is the whole) of each way in which a match can begin, as far as its letters are fixed."""
    out = []
    for row in alternatives:
        found = [("", True)]
        for piece, least, most in row:
            if isinstance(piece, list):
                ways = heads(piece)
            else:
                letters = _letters(piece)
                ways = [(c, True) for c in letters] if len(letters) <= HEAD_CLASS else [("", False)]
            if (least, most) != (1, 1):
                ways = [(w * least if len(ways) == 1 and whole else "", False) for w, whole in ways]
            found = [(a + b, whole) if ok else (a, False) for (a, ok), (b, whole) in product(found, ways)]
        out += found
    return list(dict.fromkeys(out))


class Automaton:
    """All patterns at once: one walk over a text tells which of them matches longest.

    Letters beyond ASCII are all alike to the patterns (they are in negated classes only).
    """

    def __init__(self, patterns: list[tuple[str, str]]):
        self._letters: list[list[tuple[re.Pattern, int]]] = []
        self._free: list[list[int]] = []
        self._kind_at: dict[int, int] = {}
        self.kinds = list(dict.fromkeys(kind for kind, _ in patterns))
        first = self._place()
        for kind, pattern in patterns:
            end = self._add(parse(pattern)[0], first)
            self._kind_at[end] = self.kinds.index(kind)
        self._numbers: dict[frozenset, int] = {frozenset(): DEAD}
        self._sets: list[frozenset] = [frozenset()]
        self._accepts: list[int | None] = [None]
        self._moves: dict[tuple[int, str], int] = {}
        self._start = self._number({first})

    def _place(self) -> int:
        self._letters.append([])
        self._free.append([])
        return len(self._free) - 1

    def _add(self, alternatives, start: int) -> int:
        end = self._place()
        for row in alternatives:
            at = start
            for piece, least, most in row:
                for _ in range(least):
                    at = self._piece(piece, at)
                out = self._place()
                if most is None:
                    self._free[at].append(out)
                    self._free[self._piece(piece, out)].append(out)
                else:
                    for _ in range(most - least):
                        self._free[at].append(out)
                        at = self._piece(piece, at)
                    self._free[at].append(out)
                at = out
            self._free[at].append(end)
        return end

    def _piece(self, piece, at: int) -> int:
        if isinstance(piece, list):
            return self._add(piece, at)
        to = self._place()
        self._letters[at].append((re.compile(piece, re.ASCII), to))
        return to

    def _number(self, places: set[int]) -> int:
        open_ = list(places)
        while open_:
            for p in self._free[open_.pop()]:
                if p not in places:
                    places.add(p)
                    open_.append(p)
        key = frozenset(places)
        if key not in self._numbers:
            self._numbers[key] = len(self._sets)
            self._sets.append(key)
            self._accepts.append(min((self._kind_at[p] for p in key if p in self._kind_at), default=None))
        return self._numbers[key]

    def _move(self, state: int, letter: str) -> int:
        if len(self._moves) > MOST_MOVES:
            self._moves.clear()
        to = self._number({t for p in self._sets[state] for one, t in self._letters[p] if one.match(letter)})
        self._moves[state, letter] = to
        return to

    def longest(self, text: str, at: int) -> tuple[str | None, int, bool]:
        """(kind, end, did the text end first) of the longest match that begins at ``at``; of several kinds the first named."""
        state, kind, end = self._start, None, at
        for i in range(at, len(text)):
            letter = text[i]
            if letter > "\x7f":
                letter = "\x80"
            to = self._moves.get((state, letter))
            state = self._move(state, letter) if to is None else to
            if state == DEAD:
                return kind, end, False
            if self._accepts[state] is not None:
                kind, end = self.kinds[self._accepts[state]], i + 1
        return kind, end, True
