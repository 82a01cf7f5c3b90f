"""FM-index over a sequence of integer symbols, vectorised with numpy.

Suffix array by prefix doubling over unresolved groups, Burrows-Wheeler
transform in a wavelet matrix, backward search for many patterns at once and
occurrence lookup by sampled suffix positions.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose last symbol must be smaller than all others and unique."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    rank = np.empty(n, dtype=np.int64)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    sa = order.astype(np.int64)
    h = 1
    while True:
        group = rank[sa]
        alone = np.empty(n, dtype=bool)
        alone[:-1] = group[1:] != group[:-1]
        alone[-1] = True
        alone[1:] &= group[1:] != group[:-1]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa
        places = sa[slots]
        own = group[slots]
        then = np.where(places + h < n, rank[np.minimum(places + h, n - 1)], -1)
        by = np.lexsort((then, own))
        places, own, then = places[by], own[by], then[by]
        sa[slots] = places
        fresh = np.empty(len(slots), dtype=bool)
        fresh[0] = True
        fresh[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
        rank[places] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        h *= 2


class WaveletMatrix:
    """Rank and access over integer symbols in ``levels`` bit vectors with running counts."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        current = symbols
        for level in range(levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(bool)
            counts = np.zeros(len(bits) + 1, dtype=np.int32)
            np.cumsum(bits, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(bits) - int(counts[-1]))
            current = np.concatenate((current[~bits], current[bits]))

    def __getstate__(self) -> dict:
        """Stored as bits; the counts are made anew when it is read."""
        return {"levels": self.levels, "n": len(self.ones[0]) - 1, "bits": [np.packbits(np.diff(c).astype(bool)) for c in self.ones]}

    def __setstate__(self, state: dict) -> None:
        self.levels, self.ones, self.zeros = state["levels"], [], []
        for packed in state["bits"]:
            counts = np.zeros(state["n"] + 1, dtype=np.int32)
            np.cumsum(np.unpackbits(packed, count=state["n"]), out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(state["n"] - int(counts[-1]))

    def rank(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each end."""
        at = [np.zeros_like(ends[0]), *ends]
        for k in range(self.levels):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            counts, zeros = self.ones[k], self.zeros[k]
            for i, p in enumerate(at):
                r = counts[p]
                at[i] = np.where(one, zeros + r, p - r)
        return [p - at[0] for p in at[1:]]

    def access_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before it."""
        symbols, p, zero = np.zeros_like(places), places, np.zeros_like(places)
        for k in range(self.levels):
            counts, zeros = self.ones[k], self.zeros[k]
            r = counts[p]
            one = (counts[p + 1] - r).astype(bool)
            p = np.where(one, zeros + r, p - r)
            rz = counts[zero]
            zero = np.where(one, zeros + rz, zero - rz)
            symbols = (symbols << 1) | one
        return symbols, p - zero


class FMIndex:
    """Index of one shard; symbols are 1..sigma-1, symbol 0 closes the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16) -> None:
        text = np.concatenate((text.astype(np.int64), np.zeros(1, dtype=np.int64)))
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = WaveletMatrix(text[sa - 1], max(1, int(sigma - 1).bit_length()))
        self.before = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        self.marked = sa % sample == 0
        self.marks = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def __getstate__(self) -> dict:
        return {k: np.packbits(v) if k == "marked" else v for k, v in self.__dict__.items() if k != "marks"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.marked = np.unpackbits(self.marked, count=self.n).astype(bool)
        self.marks = np.cumsum(self.marked) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix-array intervals of the rows of ``patterns`` (one pattern a row)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, column]
            a, b = self.bwt.rank(c, low[live], high[live])
            low[live], high[live] = self.before[c] + a, self.before[c] + b
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a sampled suffix."""
        out = np.full(len(rows), -1, dtype=np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            done = self.marked[at]
            out[live[done]] = self.samples[self.marks[at[done]]] + steps
            live, at = live[~done], at[~done]
            if len(live):
                c, r = self.bwt.access_rank(at)
                at = self.before[c] + r
                steps += 1
        return out
