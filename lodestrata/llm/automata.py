"""Position automata of small regular grammars: membership in linear time, and the pairs of neighbours that a grammar permits.

Syntax: single characters, ``[...]``, ``(...)``, ``|``, ``*``, ``+``, ``?``; blanks don't count; ``\\`` escapes.
"""

from __future__ import annotations


class Automaton:
    def __init__(self, grammar: str) -> None:
        self.text, self.at = grammar, 0
        self.letters: list[frozenset[str]] = []
        self.follow: list[set[int]] = []
        self.nullable, self.first, self.last = self._alternatives()
        if self.at != len(grammar):
            raise ValueError(f"unbalanced at {self.at}: {grammar[self.at:][:40]}")
        # most positions share what can follow them with many others
        kinds: dict[frozenset[int], int] = {}
        self.kind = [kinds.setdefault(frozenset(f), len(kinds)) for f in self.follow]
        self.follows = list(kinds)
        del self.follow
        self._states: dict[frozenset[int], dict[str, frozenset[int]]] = {}

    def _peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def _alternatives(self) -> tuple[bool, set[int], set[int]]:
        nullable, first, last = self._sequence()
        while self._peek() == "|":
            self.at += 1
            n, f, l = self._sequence()
            nullable, first, last = nullable or n, first | f, last | l
        return nullable, first, last

    def _sequence(self) -> tuple[bool, set[int], set[int]]:
        nullable, first, last = True, set(), set()
        while self._peek() not in ("", "|", ")"):
            n, f, l = self._item()
            for p in last:
                self.follow[p] |= f
            first = first | f if nullable else first
            last = last | l if n else l
            nullable = nullable and n
        return nullable, first, last

    def _item(self) -> tuple[bool, set[int], set[int]]:
        ch = self._peek()
        self.at += 1
        if ch == "(":
            out = self._alternatives()
            if self._peek() != ")":
                raise ValueError(f"missing ) in {self.text}")
            self.at += 1
        else:
            if ch == "[":
                letters = set()
                while (c := self.text[self.at]) != "]":
                    if c == "\\":
                        self.at += 1
                        c = self.text[self.at]
                    if not c.isspace():
                        letters.add(c)
                    self.at += 1
                self.at += 1
            else:
                if ch == "\\":
                    ch = self.text[self.at]
                    self.at += 1
                letters = {ch}
            self.letters.append(frozenset(letters))
            self.follow.append(set())
            p = len(self.letters) - 1
            out = (False, {p}, {p})
        while (ch := self._peek()) in ("*", "+", "?") and ch:
            self.at += 1
            nullable, first, last = out
            if ch in "*+":
                for p in last:
                    self.follow[p] |= first
            out = (nullable or ch in "*?", first, last)
        return out

    def _step(self, state: frozenset[int], letter: str) -> frozenset[int]:
        known = self._states.setdefault(state, {})
        if letter not in known:
            after = self.first if -1 in state else set().union(*(self.follows[k] for k in {self.kind[p] for p in state}))
            known[letter] = frozenset(p for p in after if letter in self.letters[p])
        return known[letter]

    def accepts(self, letters: str) -> bool:
        state = frozenset([-1])
        for c in letters:
            state = self._step(state, c)
            if not state:
                return False
        return self.nullable if -1 in state else not self.last.isdisjoint(state)

    def firsts(self) -> set[str]:
        return set().union(*(self.letters[p] for p in self.first)) if self.first else set()

    def lasts(self) -> set[str]:
        return set().union(*(self.letters[p] for p in self.last)) if self.last else set()

    def pairs(self) -> set[tuple[str, str]]:
        """Letters that can stand next to each other."""
        before: list[set[str]] = [set() for _ in self.follows]
        for p, k in enumerate(self.kind):
            before[k] |= self.letters[p]
        return {(a, b) for letters, after in zip(before, self.follows) for b in set().union(*(self.letters[q] for q in after)) for a in letters}
