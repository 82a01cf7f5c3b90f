"""Oversized sections cut into pieces at natural boundaries (problem 2).

The text of a section is parsed into a tree: headings over blocks, blocks being
fenced code (lines), tables (rows), lists (nested items) and paragraphs
(sentences, then words).  A subtree that fits is never opened; the parts of one
that doesn't are merged with their siblings bottom-up as long as they fit.

Defined results: a null text counts as empty; exact duplicates of a section
give one set of pieces; a null or empty ``heading_path`` adds nothing; every
piece carries the whole heading path, and where that leaves less than a tenth of
the limit for text, the path is put in front of the text with a line break and
cut with it, so nothing of it is lost; a run without any boundary is cut at the
limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.sentences import units

LIMIT, OVERLAP = 2000, 200

_FENCE = regex.compile(r"[ \t]*(```+|~~~+)")
_HEAD = regex.compile(r"[ \t]{0,3}(#{1,6})[ \t]")
_ITEM = regex.compile(r"([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]")
_ROW = regex.compile(r"[ \t]*\|")


@dataclass
class Node:
    """A contiguous part of the text; its children, if any, tile it."""

    start: int
    end: int
    kind: str = ""
    children: list["Node"] = field(default_factory=list)


def _lines(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b:
        stop = text.find("\n", a, b)
        stop = b if stop < 0 else stop + 1
        yield a, stop
        a = stop


def _tile(starts: list[int], a: int, b: int, kind: str) -> list[Node]:
    """Children that begin at the given places and cover a..b."""
    at = sorted({a, *(s for s in starts if a < s < b)})
    return [Node(x, y, kind) for x, y in zip(at, [*at[1:], b])]


def _blocks(text: str, a: int, b: int) -> list[Node]:
    """Blocks of a..b with their blank lines, tiling it."""
    out: list[Node] = []
    kind, begun, fence, blank = "", a, "", True
    for x, y in _lines(text, a, b):
        line = text[x:y]
        if fence:
            if line.strip().startswith(fence):
                fence, blank = "", True
            continue
        opened = _FENCE.match(line)
        if not line.strip():
            blank = True
            continue
        now = "code" if opened else "head" if _HEAD.match(line) else "table" if _ROW.match(line) else "list" if _ITEM.match(line) else "text"
        if kind == "list" and now == "text" and not blank:
            now = "list"
        if kind and x > begun and (now != kind or now in ("code", "head") or (blank and now == "text") or kind == "head"):
            out.append(Node(begun, x, kind or now))
            begun = x
        kind, blank = now, False
        if opened:
            fence = opened.group(1)[:3]
    if begun < b:
        out.append(Node(begun, b, kind or "text"))
    return out


def _open(text: str, node: Node) -> list[Node]:
    """The parts of a node, one step down; none if only characters are left."""
    if node.children:
        return node.children
    a, b, kind = node.start, node.end, node.kind
    if kind in ("code", "table"):
        parts = _tile([x for x, _ in _lines(text, a, b)], a, b, "words")
    elif kind == "list":
        marks = [(x, len(m.group(1).expandtabs(4))) for x, y in _lines(text, a, b) if (m := _ITEM.match(text[x:y]))]
        depth = min((d for x, d in marks if x > a), default=0)
        own = [x for x, d in marks if d <= depth]
        parts = _tile(own, a, b, "list" if len(own) > 1 else "text")
        if len(parts) == 1:
            parts = _tile([x for x, _ in marks], a, b, "text")
    elif kind == "words":
        parts = _tile([a + m.end() for m in regex.finditer(r"\s+", text[a:b])], a, b, "char")
    elif kind == "char":
        parts = []
    else:
        parts = _tile([a + s for s, _ in units(text[a:b])], a, b, "words")
    if len(parts) == 1 and kind not in ("words", "char"):
        return _open(text, Node(a, b, "words"))
    return parts if len(parts) > 1 else []


def tree(text: str) -> Node:
    """The structure tree: headings hold what follows them, down to the next heading of their rank or above."""
    root = Node(0, len(text), "root")
    stack: list[tuple[int, Node]] = [(0, root)]
    for block in _blocks(text, 0, len(text)):
        if block.kind == "head":
            rank = len(_HEAD.match(text[block.start : block.end].lstrip()).group(1))
            while stack[-1][0] >= rank:
                stack.pop()
            section = Node(block.start, block.end, "section", [block])
            stack[-1][1].children.append(section)
            stack.append((rank, section))
        else:
            stack[-1][1].children.append(block)
        for _, holder in stack:
            holder.end = block.end
    root.end = len(text)
    return root


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlapped characters) of the pieces; start lies so many characters before the piece's own text."""
    overlap = min(overlap, limit // 4)
    budget = limit - overlap

    def spans(node: Node) -> list[tuple[int, int]]:
        if node.end - node.start <= budget:
            return [(node.start, node.end)]
        parts = _open(text, node)
        if not parts:
            return [(x, min(x + budget, node.end)) for x in range(node.start, node.end, budget)]
        merged: list[tuple[int, int]] = []
        for part in parts:
            for a, b in spans(part):
                if merged and b - merged[-1][0] <= budget:
                    merged[-1] = (merged[-1][0], b)
                else:
                    merged.append((a, b))
        return merged

    if len(text) <= limit:
        return [(0, len(text), 0)]
    own = spans(tree(text))
    out = [(*own[0], 0)]
    for (pa, _), (a, b) in zip(own, own[1:]):
        back = _overlap_start(text, max(pa, a - overlap), a)
        out.append((back, b, a - back))
    return out


def _overlap_start(text: str, low: int, a: int) -> int:
    """Where the overlap before ``a`` begins: the earliest line, sentence or word start that isn't before ``low``."""
    if low >= a:
        return a
    line = text.find("\n", low, a - 1)
    if low == 0 or text[low - 1] == "\n":
        return low
    sentence = next((low + s for s, _ in units(text[low:a])[1:]), -1)
    found = [x for x in (line + 1 if line >= 0 else -1, sentence) if x >= 0]
    if found:
        return min(found)
    blank = regex.search(r"\s+", text[low:a])
    return low + blank.end() if blank else low


def _heading() -> Column:
    path = F.filter("heading_path", lambda x: x.isNotNull())
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise("")


def section_pieces(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """Rows (section_id, document_id, position, piece, n_pieces, section_chars, heading, start_char, end_char, overlap_chars, text).

    One deduplicating shuffle by content, then a narrow pass; sections that fit
    pass through without being parsed.
    """
    source = sections.select("id", "document_id", "position", _heading().alias("_heading"), F.coalesce("text", F.lit("")).alias("_text"))
    size = F.length("_text") + F.when(F.col("_heading") != "", F.length("_heading") + 1).otherwise(0)
    source = source.withColumn("_size", size)
    if oversized_only:
        source = source.where(F.col("_size") > limit)
    source = source.dropDuplicates()
    fits = source.where(F.col("_size") <= limit).select(
        F.col("id").alias("section_id"), "document_id", "position", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.col("_size").alias("section_chars"),
        F.col("_heading").alias("heading"), F.lit(0).alias("start_char"), F.length("_text").alias("end_char"), F.lit(0).alias("overlap_chars"), F.col("_text").alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                heading, text = r[3], r[4]
                if heading and limit - len(heading) - 1 < limit // 10:  # no room beside it
                    heading, text = "", f"{heading}\n{text}"
                found = cut(text, limit - (len(heading) + 1 if heading else 0), overlap)
                rows += [(r[0], r[1], r[2], k, len(found), r[5], heading, a, b, o, text[a:b]) for k, (a, b, o) in enumerate(found)]
            out = pd.DataFrame(rows, columns=["section_id", "document_id", "position", "piece", "n_pieces", "section_chars", "heading", "start_char", "end_char", "overlap_chars", "text"])
            out["position"] = out["position"].astype("Int64")
            yield out

    kinds = "section_id string, document_id string, position int, piece int, n_pieces int, section_chars int, heading string, start_char int, end_char int, overlap_chars int, text string"
    over = source.where(F.col("_size") > limit).mapInPandas(run, kinds)
    return over if oversized_only else fits.unionByName(over)


def oversized_sections(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The distinct sections that the cutter had to take apart."""
    return section_pieces(sections, limit, overlap, oversized_only=True).where("n_pieces > 1").select("section_id").distinct()
