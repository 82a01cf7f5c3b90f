"""Markdown, HTML, plain text and paged texts as sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SECTION = "path string, title string, position int, depth int, heading_path array<string>, text string, id string"


def _slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", text.lower()).strip("-")


def _ids(path: str, rows: list[tuple[int, list[str], str]]) -> list[tuple[int, list[str], str, str]]:
    """Section ids; repeated ones get -2, -3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for depth, heads, text in rows:
        base = f"{path}#{'/'.join(_slug(h) for h in heads) if heads else 'root'}"
        seen[base] = seen.get(base, 0) + 1
        out.append((depth, heads, text, base if seen[base] == 1 else f"{base}-{seen[base]}"))
    return out


def markdown_sections(text: str) -> tuple[str, list[tuple[int, list[str], str]]]:
    """(title, sections); front matter is skipped, headings in fenced code don't count."""
    text = re.sub(r"\A---\r?\n.*?\r?\n---\r?\n", "", text, flags=re.S)
    stack: list[tuple[int, str]] = []
    rows: list[tuple[int, list[str], list[str]]] = [(0, [], [])]
    fence = None
    for line in text.splitlines():
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark:
            fence = None if fence and line.strip().startswith(fence) else fence or mark.group(1)
        head = None if fence or mark else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if head:
            rank = len(head.group(1))
            while stack and stack[-1][0] >= rank:
                stack.pop()
            stack.append((rank, head.group(2)))
            rows.append((len(stack), [h for _, h in stack], []))
        else:
            rows[-1][2].append(line)
    done = [(d, h, "\n".join(x).strip()) for d, h, x in rows]
    title = next((h[0] for _, h, _ in done if h), "")
    return title, [r for r in done if r[1] or r[2]]


class _Reader(HTMLParser):
    """Headings, blocks, lists and tables of a page as markdown lines; chrome is skipped."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "svg"}

    def __init__(self, whole: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.title, self.skipped, self.in_title, self.pre = "", 0, False, False
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []
        self.href: list[str] = []
        self.whole = whole

    def _break(self, n: int = 1) -> None:
        if self.lines[-1].strip():
            self.lines.append("")
        if n > 1 and len(self.lines) > 1 and self.lines[-2] != "":
            self.lines.append("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = dict(attrs)
        if tag in self.SKIP:
            self.skipped += 1
        if self.skipped:
            return
        if tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self._break(2)
            self.lines[-1] = "#" * int(tag[1]) + " "
        elif tag in ("p", "div", "section", "article", "blockquote", "table"):
            self._break(2 if tag in ("p", "blockquote", "table") else 1)
            if tag == "blockquote":
                self.lines[-1] = "> "
            if tag == "table":
                self.rows = []
        elif tag in ("ul", "ol"):
            self._break()
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self._break()
            self.lists[-1][1] += 1
            self.lines[-1] = "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- ")
        elif tag == "br":
            self.lines.append("")
        elif tag == "pre":
            self._break(2)
            self.lines += ["```", ""]
            self.pre = True
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "a":
            self.href.append(at.get("href") or "")
            self._put("[")
        elif tag == "img":
            self._put(f"![{at.get('alt') or ''}]({at.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped:
            return
        if tag == "title":
            self.in_title = False
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "blockquote"):
            self._break(2)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._break(2 if not self.lists else 1)
        elif tag == "pre":
            if self.lines[-1] == "":
                self.lines.pop()
            self.lines += ["```", ""]
            self.pre = False
        elif tag == "tr" and self.row is not None:
            self.rows.append([c.strip() for c in self.row])
            self.row = None
        elif tag == "table" and self.rows:
            width = max(map(len, self.rows))
            rows = [r + [""] * (width - len(r)) for r in self.rows]
            self.lines += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * width, *("| " + " | ".join(r) + " |" for r in rows[1:]), ""]
            self.rows = []
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "a" and self.href:
            self._put(f"]({self.href.pop()})")

    def _put(self, text: str) -> None:
        if self.row:
            self.row[-1] += text
        elif self.row is None:
            self.lines[-1] += text

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if self.skipped or self.in_title:
            return
        if self.pre:
            head, *rest = data.split("\n")
            self.lines[-1] += head
            self.lines += rest
            return
        text = re.sub(r"\s+", " ", data)
        if text != " " or self.lines[-1].strip():
            self._put(text if self.lines[-1] or self.row is not None else text.lstrip())


def html_to_markdown(page: str) -> tuple[str, str]:
    """(title, markdown) of a page."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in reader.lines)).strip()
    return reader.title.strip(), text


class _Blocks(HTMLParser):
    """Lengths of the children of the body, for choosing the main one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.spans: list[dict] = []
        self.open: list[dict] = []
        self.link = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            return
        depth = len(self.stack)
        self.stack.append(tag)
        if tag in ("main", "article") or depth and self.stack[-2] == "body" and tag not in _Reader.SKIP:
            self.open.append({"tag": tag, "at": self.getpos(), "depth": depth, "len": 0, "p": 0, "links": 0, "end": None})
        if tag == "p":
            for o in self.open:
                o["p"] += 1
        self.link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            self.link -= top == "a"
            if self.open and self.open[-1]["depth"] == len(self.stack):
                o = self.open.pop()
                o["end"] = self.getpos()
                self.spans.append(o)
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if not _Reader.SKIP.intersection(self.stack):
            for o in self.open:
                o["len"] += len(data.strip())
                o["links"] += len(data.strip()) if self.link > 0 else 0


def main_content(page: str) -> str:
    """The part of a page that holds its content: main, else article, else the child of the body with the best score."""
    blocks = _Blocks()
    blocks.feed(page)
    blocks.close()
    starts = [0]
    for line in page.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    cut = lambda o: page[starts[o["at"][0] - 1] + o["at"][1] : starts[o["end"][0] - 1] + o["end"][1]]
    for wanted in ("main", "article"):
        found = [o for o in blocks.spans if o["tag"] == wanted]
        if found:
            return cut(min(found, key=lambda o: o["at"]))
    score = lambda o: 0 if o["len"] < 25 else o["len"] + 10 * o["p"] - 2 * o["links"]
    best = max(blocks.spans, key=score, default=None)
    return cut(best) if best and score(best) > 0 else page


def _parsed(files: DataFrame, parse: Callable[[str], tuple[str, list[tuple[int, list[str], str]]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                title, found = parse(text or "")
                rows += [(path, title, k, d, h, t, i) for k, (d, h, t, i) in enumerate(_ids(path or "", found))]
            yield pd.DataFrame(rows, columns=["path", "title", "position", "depth", "heading_path", "text", "id"])

    return files.select("path", "content").mapInPandas(run, SECTION)


def read_markdown(files: DataFrame) -> DataFrame:
    """Sections of Markdown files (path, content)."""
    return _parsed(files, markdown_sections)


def read_html(pages: DataFrame, main_only: bool = False) -> DataFrame:
    """Sections of pages (path, content)."""

    def parse(page: str) -> tuple[str, list]:
        title, text = html_to_markdown(page)
        if main_only:
            text = html_to_markdown(main_content(page))[1]
        first, rows = markdown_sections(text)
        return title or first, rows

    return _parsed(pages, parse)


def read_paged(pages: DataFrame) -> DataFrame:
    """Sections of paged documents (path, page, text), one a page that isn't empty; the title is the first short line or the file's name."""
    kept = pages.where(F.length(F.trim("text")) > 0)
    title = F.first("line", ignorenulls=True)
    first = F.element_at(F.filter(F.split(F.trim("text"), "\n"), lambda x: F.trim(x) != ""), 1)
    titles = kept.withColumn("line", F.when(F.length(first) <= 200, first)).groupBy("path").agg(F.min(F.struct("page", "line"))["line"].alias("title"))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    heading = F.format_string("Page %d", F.col("page"))
    return kept.join(titles, "path").select("path", F.coalesce("title", stem).alias("title"), (F.col("page") - 1).cast("int").alias("position"), F.lit(1).alias("depth"), F.array(heading).alias("heading_path"), "text", F.concat("path", F.lit("#page-"), F.col("page").cast("string")).alias("id"))


def read_text(files: DataFrame) -> DataFrame:
    """Plain files as one section each."""
    return files.where(F.length("content") > 0).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("title"), F.lit(0).alias("position"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("heading_path"), F.col("content").alias("text"), F.concat("path", F.lit("#root")).alias("id"))
