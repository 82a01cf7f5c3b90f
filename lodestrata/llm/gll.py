"""Generalised LL parsing with a graph-structured stack and error recovery.

A grammar maps each nonterminal to its alternatives; every other symbol is a
terminal, compared with the set of names a token answers to.  Left recursion
and ambiguity need no rewriting.  When the input doesn't parse, the parser goes
on from the furthest places reached, each time leaving out one token or
supplying the terminal that was expected there.
"""

from __future__ import annotations

from collections import defaultdict

Grammar = dict[str, list[list[str]]]


class Parse:
    """The extents that were recognised: (nonterminal, start) -> ends."""

    def __init__(self, parser: "Parser", tokens: list[frozenset[str]], ends: dict, repairs: dict[tuple[int, int], int], cost: int) -> None:
        self.parser, self.tokens, self.ends, self.repairs, self.cost = parser, tokens, ends, repairs, cost
        self._memo: dict = {}

    def derive(self, name: str, start: int, end: int) -> list | None:
        """A derivation [name, start, end, children]; of those with the fewest repairs the first alternative, and the longest first parts."""
        if self.repairs:
            best = self._cheapest(name, start, end)
            return best[1] if best else None
        key = (name, start, end)
        if key in self._memo:
            return self._memo[key]
        self._memo[key] = None
        if end in self.ends.get((name, start), ()):
            for alternative in self.parser.grammar[name]:
                children = self._sequence(alternative, 0, start, end)
                if children is not None:
                    self._memo[key] = [name, start, end, children]
                    break
        return self._memo[key]

    def _sequence(self, symbols: list[str], k: int, at: int, end: int) -> list | None:
        if k == len(symbols):
            return [] if at == end else None
        s = symbols[k]
        if s in self.parser.grammar:
            for stop in sorted((e for e in self.ends.get((s, at), ()) if e <= end), reverse=True):
                rest = self._sequence(symbols, k + 1, stop, end)
                if rest is not None:
                    own = self.derive(s, at, stop)
                    if own is not None:
                        return [own, *rest]
            return None
        if at < end and s in self.tokens[at]:
            rest = self._sequence(symbols, k + 1, at + 1, end)
            if rest is not None:
                return [at, *rest]
        return None

    def _cheapest(self, name: str, start: int, end: int) -> tuple[int, list] | None:
        key = (name, start, end)
        if key not in self._memo:
            self._memo[key] = None
            if end in self.ends.get((name, start), ()):
                for i in range(len(self.parser.grammar[name])):
                    own = self._cheapest_part(name, i, 0, start, end)
                    if own is not None and (self._memo[key] is None or own[0] < self._memo[key][0]):
                        self._memo[key] = (own[0], [name, start, end, own[1]])
        return self._memo[key]

    def _cheapest_part(self, name: str, i: int, k: int, at: int, end: int) -> tuple[int, list] | None:
        symbols = self.parser.grammar[name][i]
        if k == len(symbols):
            return (0, []) if at == end else None
        key = (name, i, k, at, end)
        if key in self._memo:
            return self._memo[key]
        self._memo[key] = best = None
        s = symbols[k]
        if s in self.parser.grammar:
            for stop in sorted((e for e in self.ends.get((s, at), ()) if e <= end), reverse=True):
                rest = self._cheapest_part(name, i, k + 1, stop, end)
                own = self._cheapest(s, at, stop) if rest is not None else None
                if own is not None and (best is None or own[0] + rest[0] < best[0]):
                    best = own[0] + rest[0], [own[1], *rest[1]]
        else:
            ways = [(0, k + 1, at + 1, [at])] if at < end and s in self.tokens[at] else []
            ways += [(1, k, at + 1, [])] if (at, 1) in self.repairs and at < end else []
            ways += [(1, k + 1, at, [])] if s in self.repairs.get((at, 0), ()) else []
            for cost, then, place, own_part in ways:
                rest = self._cheapest_part(name, i, then, place, end)
                if rest is not None and (best is None or cost + rest[0] < best[0]):
                    best = cost + rest[0], [*own_part, *rest[1]]
        self._memo[key] = best
        return best


class Parser:
    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.symbols: list[str | None] = []
        self.starts: dict[str, list[int]] = {}
        for name, alternatives in grammar.items():
            self.starts[name] = []
            for alternative in alternatives:
                self.starts[name].append(len(self.symbols))
                self.symbols += [*alternative, None]
        self._first()

    def _first(self) -> None:
        """Terminals with which each alternative can begin; None stands for the empty one."""
        first: dict[str, set] = {n: set() for n in self.grammar}

        def of(alternative: list[str]) -> set:
            out: set = set()
            for s in alternative:
                more = first[s] if s in self.grammar else {s}
                out |= more - {None}
                if None not in more:
                    return out
            return out | {None}

        changed = True
        while changed:
            changed = False
            for n, alternatives in self.grammar.items():
                for a in alternatives:
                    new = of(a) - first[n]
                    if new:
                        first[n] |= new
                        changed = True
        self.begins = {n: [(slot, None if None in (f := of(a)) else frozenset(f)) for slot, a in zip(self.starts[n], alternatives)] for n, alternatives in self.grammar.items()}

    def parse(self, tokens: list[frozenset[str]], start: str, budget: int = 6, whole: bool = True) -> Parse | None:
        """Parse from the first token; with ``whole`` to the last one.  ``budget`` bounds the repairs."""
        n, grammar, symbols = len(tokens), self.grammar, self.symbols
        root = (start, 0)
        edges: dict[tuple, set] = defaultdict(set)
        ends: dict[tuple, set] = defaultdict(set)
        seen: set = set()
        work: list[tuple[int, tuple, int]] = []
        failed: list[tuple[int, tuple, int]] = []
        repairs: dict[tuple[int, int], set] = {}
        cost = 0

        def enter(node: tuple) -> None:
            now = tokens[node[1]] if node[1] < n else None
            for slot, first in self.begins[node[0]]:
                if first is None or now is not None and first & now:
                    item = (slot, node, node[1])
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
                else:
                    failed.append((slot, node, node[1]))

        enter(root)
        while True:
            while work:
                slot, node, at = work.pop()
                s = symbols[slot]
                if s is None:
                    if at not in ends[node]:
                        ends[node].add(at)
                        for back, above in edges[node]:
                            item = (back, above, at)
                            if item not in seen:
                                seen.add(item)
                                work.append(item)
                elif s in grammar:
                    below = (s, at)
                    link = (slot + 1, node)
                    known = below in edges or below == root
                    if link not in edges[below]:
                        edges[below].add(link)
                        for e in list(ends[below]):
                            item = (slot + 1, node, e)
                            if item not in seen:
                                seen.add(item)
                                work.append(item)
                    if not known:
                        enter(below)
                elif at < n and s in tokens[at]:
                    item = (slot + 1, node, at + 1)
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
                else:
                    failed.append((slot, node, at))
            good = ends[root]
            if (n in good) if whole else good:
                return Parse(self, tokens, ends, repairs, cost)
            if cost >= budget or not failed:
                return None
            cost += 1
            far = max(f[2] for f in failed)
            again, failed = failed, []
            for slot, node, at in again:
                if at < far:
                    failed.append((slot, node, at))
                    continue
                s = symbols[slot]
                if at < n:
                    repairs.setdefault((at, 1), set())
                    item = (slot, node, at + 1)
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
                if s is not None and s not in grammar:
                    repairs.setdefault((at, 0), set()).add(s)
                    item = (slot + 1, node, at)
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
