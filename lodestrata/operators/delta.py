"""Line deltas of two versions, and condensing of results to a budget."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def line_delta(old: str, new: str) -> list[tuple[str, str]]:
    """(op, line) with op context, removed or added, by a longest common subsequence, read from the ends.

    Equal last lines are context; else a last line of the new text counts as added
    unless leaving it out costs a common line.  So the common tail is always
    context and is taken off first; of the table only two rows of lengths and one
    mark a cell are kept.
    """
    a, b = old.split("\n") if old else [], new.split("\n") if new else []
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[: len(a) - tail], b[: len(b) - tail]
    same, add, drop = 0, 1, 2
    marks = [bytearray([add]) * (len(y) + 1)]
    above = [0] * (len(y) + 1)
    for u in x:
        row, lengths = bytearray([drop]) * (len(y) + 1), [0] * (len(y) + 1)
        for j, v in enumerate(y, 1):
            lengths[j] = above[j - 1] + 1 if u == v else max(above[j], lengths[j - 1])
            row[j] = same if u == v else add if lengths[j - 1] >= above[j] else drop
        marks.append(row)
        above = lengths
    out = [("context", line) for line in reversed(a[len(a) - tail :])]
    i, j = len(x), len(y)
    while i or j:
        mark = marks[i][j]
        i, j = i - (mark != add), j - (mark != drop)
        out.append((("context", "added", "removed")[mark], y[j] if mark == add else x[i]))
    return out[::-1]


def deltas(pairs: DataFrame) -> DataFrame:
    """(id, n, op, line) of pairs (id, old, new); null counts as empty."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.id, n, op, line) for r in batch.itertuples(index=False) for n, (op, line) in enumerate(line_delta(r.old or "", r.new or ""))]
            yield pd.DataFrame(rows, columns=["id", "n", "op", "line"])

    return pairs.select("id", "old", "new").mapInPandas(run, f"id {kind}, n int, op string, line string")


#: The tokens of a result, and what is kept back of them for the note on what was cut.
BUDGET, RESERVE = 22_000, 220


def count_tokens(text: str) -> int:
    """An estimate that needs no vocabulary: four bytes a token."""
    return -(-len(text.encode("utf-8", "surrogatepass")) // 4)


def _cost(value: object, count: Callable[[str], int]) -> int:
    return count(json.dumps(value, ensure_ascii=False))


def shorten(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> str:
    """The sentences of greatest mean tf-idf that fit into the budget, in their order; of one sentence alone its words that fit."""
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if x.strip()]
    words = [re.findall(r"\w+", x.lower()) for x in sentences]
    seen = Counter(w for ws in words for w in set(ws))
    score = [sum(math.log(len(sentences) / seen[w]) for w in ws) / max(1, len(ws)) for ws in words]
    kept, left = set(), budget
    for k in sorted(range(len(sentences)), key=lambda k: (-score[k], k)):
        n = count(sentences[k]) + 1
        if n <= left:
            kept.add(k)
            left -= n
    if kept:
        return " ".join(sentences[k] for k in sorted(kept))
    out: list[str] = []
    for word in text.split():
        if count(" ".join([*out, word, "…"])) > budget:
            break
        out.append(word)
    return " ".join([*out, "…"])


def condense(result: dict, budget: int = BUDGET, count: Callable[[str], int] = count_tokens) -> dict:
    """A result within so many tokens: fields are served from the cheapest on, each by an equal share of what is left; texts are summarised, lists lose their last elements, and what was cut is told."""
    original = _cost(result, count)
    if original <= budget:
        return result
    cut = {"reduced_fields": 0, "omitted_elements": 0}

    def fit(value: object, most: int) -> object:
        if _cost(value, count) <= most:
            return value
        if isinstance(value, str):
            cut["reduced_fields"] += 1
            return shorten(value, most, count)
        if isinstance(value, dict):
            left, out = most, {}
            fields = sorted(value, key=lambda k: _cost(value[k], count))
            for n, k in enumerate(fields):
                left = max(0, left - count(k) - 4)
                out[k] = fit(value[k], left // (len(fields) - n))
                left = max(0, left - _cost(out[k], count))
            return {k: out[k] for k in value}
        if isinstance(value, list):
            left, kept = most - 2, []
            for n, x in enumerate(value):
                own = fit(x, max(left // 2, left // (len(value) - n)))
                price = _cost(own, count) + 1
                if price > left and kept:
                    cut["omitted_elements"] += len(value) - n
                    break
                kept.append(own)
                left -= price
            return kept
        return value

    out = fit(result, max(1, budget - RESERVE))
    return {**out, "_condensed": {"budget": budget, "original": original, **cut}}
