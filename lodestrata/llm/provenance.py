"""Files that aren't hand-written: generated, minified, third-party, or data stored as code (problem 5).

Third-party copies are found by an inverted index of rare line hashes, comments
and blanks removed.  Known are the upstream files and, across repositories, the
files that stand in dependency folders; of each, the rarest lines are indexed, so
many that a file which holds ``CONTAINMENT`` of its lines holds one of them.  The
exact containment of all lines decides.  Paths name dependency folders and emitted
files.  What is left is judged by its composition: leading and closing comment
blocks, line shapes, the share of literals, and series of blocks that differ only
by a counter.

Defined results: null and empty contents are hand-written unless their path says
otherwise; repeated rows give one path; a file is listed once, with the first
class that holds in the order third-party, generated, minified, blob; a file of a
dependency folder is known only with ``KNOWN_LINES`` or more lines of code, for
shorter ones occur by chance.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.llm.syntax import language_of
from lodestrata.session import settle, spread

#: The share of an upstream file's lines that a copy of it holds.
CONTAINMENT = 0.8
#: The least lines of code of a dependency file whose copies are looked for.
KNOWN_LINES = 10
#: The most line hashes that are broadcast; beyond it the join shuffles.
BROADCAST_LINES = 1_000_000

# Folders of dependencies, of emitted files, and names of emitted and minified files.
DEPENDENCY_PATH = r"(^|/)(node_modules|bower_components|jspm_packages|vendor|third[-_]?party|3rd[-_]?party|external|externals|Pods|Carthage|_?_?vendored|_vendor|site-packages|dist-packages|\.?venv|virtualenv|\.cargo/registry|\.gradle|\.m2|go/pkg/mod)/"
EMITTED_PATH = r"(^|/)(dist/gen|generated(-sources|-src)?|__generated__|autogen|gen/src|target/(debug|release)|build/(out|generated|gen)|\.next|\.nuxt)/|(^|/)gen/[^/]*$|(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|c|js|ts|rs|java)|\.generated\.\w+|[._-]gen\.\w+|\.g\.\w+|\.designer\.\w+|_generated\.\w+)$"
MINIFIED_PATH = r"[._-](min|bundle|bundled|packed|prod)\.(js|mjs|cjs|ts|css)$"

#: A line that says of its own file that a program made it; what it says of other files or of strings doesn't begin so.
_HEADER = re.compile(
    r"^\W*(?:(?:this|the following) (?:source |output )?(?:file|code|module|class|header|script) (?:is|was|has been) |(?:diese|ce|cet|este|esta|этот|данный) \w+ (?:ist|wurde|est|a été|es|fue|ha sido|é|foi|был)? ?)?(?:code |file |source )?"
    r"(?:@generated\b|<auto-?generated|auto-?\s?generated\b|automatically (?:generated|created|written|produced)\b|generated (?:by|from|file|code|using|with|on|automatically)\b|machine[- ](?:written|generated|made)\b|(?:written|produced|emitted|created|built|compiled) by (?:the )?\S+ (?:compiler|generator)\b"
    r"|(?-i:DO NOT (?:EDIT|MODIFY|CHANGE)\b)|do not (?:edit|modify|change|touch)\b.*\b(?:output|generated|generator|compiler|template|schema|overwritten|lost)\b|(?:edits|changes) (?:here |to this file )?will be (?:lost|overwritten)"
    r"|nicht (?:bearbeiten|ändern|editieren)|erzeugt (?:von|durch|aus)|automatisch (?:erzeugt|generiert)|ne pas (?:modifier|éditer|toucher)|généré (?:par|depuis|automatiquement)|no (?:editar|modificar)\b|generado (?:por|desde|automáticamente)|не (?:редактировать|изменять|править)|сгенерирован|создано автоматически|não (?:editar|modificar)|gerado (?:por|automaticamente)|\w*自動生成|\w*自动生成|編集しない|請勿|请勿|\w*자동 생성)",
    re.I,
)
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|endif|undef|else|error|line)\b|!?\[)|/\*|\*|<!--|--\s|;|\"\"\"|''')|\s*$")


# What opens and closes a comment over several lines.
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def _edges(lines: list[str]) -> list[str]:
    """The comment lines with which a file opens and closes; block comments and docstrings are followed to their end."""
    out = []
    for side, backward in ((lines, False), (lines[::-1], True)):
        until = ""
        for n, line in enumerate(side):
            out.append(line)
            bare = line.strip()
            if until:
                if until in bare:
                    until = ""
                continue
            ends = [(closed, opened) if backward else (opened, closed) for opened, closed in _BLOCKS]
            near, far = next(((x, y) for x, y in ends if (bare.endswith(x) if backward else bare.lstrip("rRuUbB").startswith(x))), ("", ""))
            if near:
                rest = bare[: -len(near)] if backward else bare.lstrip("rRuUbB")[len(near) :]
                if far not in rest and (other := next((x for x in side[n + 1 :] if far in x), None)) is not None:
                    if backward and not other.lstrip(" \trRuUbB").startswith(far):  # a literal, or code before the comment
                        out.pop()
                        break
                    until = far
                elif backward and not _COMMENT_LINE.match(line):
                    out.pop()
                    break
            elif not _COMMENT_LINE.match(line):
                out.pop()
                break
        if len(out) >= len(lines):
            break
    return out


def _series(text: str) -> bool:
    """Whether most blocks of a file repeat one shape, on as many lines, with a figure that counts up or down."""
    blocks = [b for b in re.split(r"\n[ \t]*\n", text) if sum(1 for line in b.split("\n") if line.strip()) >= 3]
    heights = [b.count("\n") for b in blocks]
    if not any(x == y == z for x, y, z in zip(heights, heights[1:], heights[2:])):
        return False
    shapes, figures = [], []
    for b in blocks:
        b = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "S", b)
        plain = re.sub(r"\b[^\W\d]\w*", "x", b)
        figures.append([int(n) for n in re.findall(r"(?<![\w.])\d{1,15}(?![\w.])", b)])
        shapes.append(f"{b.count(chr(10))} {re.sub(r'\s+', ' ', re.sub(r'\d+', '9', plain)).strip()}")
    best, at = 0, 0
    while at < len(shapes):
        end = at
        while end + 1 < len(shapes) and shapes[end + 1] == shapes[at] and len(figures[end + 1]) == len(figures[at]):
            end += 1
        n = end - at + 1
        if n >= 3:
            for column in zip(*figures[at : end + 1]):
                steps = {b - a for a, b in zip(column, column[1:])}
                if len(steps) == 1 and steps != {0}:
                    best = max(best, n)
                    break
        at = end + 1
    return best >= 3 and 2 * best >= len(blocks)


_PAYLOAD = re.compile(r"[\"'`]([A-Za-z0-9+/=_\-]{40,})[\"'`]|^\s*([A-Za-z0-9+/=]{60,})\s*$", re.M)
_FIGURE = re.compile(r"(?<![\w.])[+\-]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?)\w{0,3}(?![\w.])")
_IDENTIFIER = re.compile(r"\b[^\W\d]\w*")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f\ufffd]")
_ROW_END = frozenset(",]})S'\"._")


def composition(text: str | None, language: str) -> str | None:
    """generated, minified or blob by what a file is made of; None for hand-written."""
    if not text:
        return None
    n = len(text)
    if len(_CONTROL.findall(text)) > 0.01 * n:
        return "blob"
    lines = text.replace("\r\n", "\n").split("\n")
    if any(map(_HEADER.match, _edges(lines))):
        return "generated"
    if language in ("json", "toml"):
        return None
    blanks = sum(text.count(c) for c in " \t\n\r")
    payload = sum(len(a or b) for a, b in _PAYLOAD.findall(text))
    stripped = [x for line in lines if (x := line.strip())]
    code = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", text)
    bare = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "S", code)
    figures, words = len(_FIGURE.findall(bare)), len(_IDENTIFIER.findall(bare))
    if payload > 0.6 * n and n > 400 or figures >= 100 and figures >= 0.85 * (figures + words):
        return "blob"
    rows = len(stripped)
    if rows >= 20 and sum(x[-1] in _ROW_END or x[-1].isalnum() for x in stripped) >= 0.8 * rows:  # else no shape that ends so is frequent enough
        shapes = Counter(re.sub(r"\d[\w.]*", "9", re.sub(r"[^\W\d]\w*", "x", re.sub(r"\"[^\"]*\"|'[^']*'", "S", x))) for x in stripped)
        top, often = shapes.most_common(1)[0]
        if often >= 0.8 * rows and top.endswith((",", "]", "}", ")", "S", "9")):
            return "blob"
    if language in ("js", "ts", "css") and n >= 200 and blanks < 0.12 * n and n > 80 * len(lines):
        return "minified"
    if _series(text):
        return "generated"
    return None


def _code_lines(content: Column, language: Column) -> Column:
    """Lines without comments and blanks; only those of at least four characters."""
    bare = F.regexp_replace(content, r"(?s)/\*.*?\*/|//[^\n]*", "")
    hashed = F.regexp_replace(bare, r"(?m)^[ \t]*#[^\n]*|[ \t]#[^\n]*", "")
    packed = F.regexp_replace(F.when(language.isin("py", "toml"), hashed).otherwise(bare), r"[ \t\r\f\x0B]+", "")
    return F.filter(F.split(packed, "\n"), lambda x: F.length(x) >= 4)


def _line_hashes(files: DataFrame, key: str, language: Column) -> DataFrame:
    """(key, h) of the distinct lines of each content."""
    return files.select(key, F.explode(F.array_distinct(_code_lines(F.col("content"), language))).alias("line")).select(key, F.xxhash64("line").alias("h"))


def _bounded(side: DataFrame) -> DataFrame:
    """The side as a broadcast, if its counted rows are within the bound."""
    return F.broadcast(side) if side.count() <= BROADCAST_LINES else side


def copies(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, source, containment) of the files that hold a known file: ``u<id>`` of an upstream file, ``f<id>`` of a file in a dependency folder.

    One narrow pass makes line hashes; only those that known files have are kept,
    so what is shuffled grows with the matches, not with the corpus.  Known files
    of the same lines are one, named by the least source.
    """
    language = language_of("path")
    own = spread(files.select("file_id", "path", "content").where("length(content) > 0"))
    lines = _line_hashes(own, "file_id", language)
    # an upstream file has no path; both ways of reading its comments are known
    plain = upstream.select(F.concat(F.lit("u"), F.col("upstream_id").cast("string")).alias("name"), "content").where("length(content) > 0")
    ways = [_line_hashes(plain.select(F.concat_ws(" ", "name", F.lit(k)).alias("source"), "content"), "source", F.lit(k)) for k in ("py", "js")]
    kept = own.where(F.col("path").rlike(DEPENDENCY_PATH) & ~language.isin("json", "toml")).select(F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("source"), "path", "content")
    kept = _line_hashes(kept, "source", language)
    many = kept.groupBy("source").agg(F.countDistinct("h").alias("n")).where(F.col("n") >= KNOWN_LINES)
    listed = settle(ways[0].unionAll(ways[1]).unionAll(kept.join(many, "source", "left_semi")).distinct())
    # one source for all that have the same lines
    sets = listed.groupBy("source").agg(F.count("*").alias("size"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("mix"))
    first = sets.groupBy("size", "sum", "mix").agg(F.min("source").alias("source"))
    known = settle(listed.join(first.select("source", "size"), "source"))
    matched = settle(lines.join(_bounded(settle(known.select("h").distinct())), "h", "left_semi"))
    # a file that holds the share of a source's lines misses the fewest of them, so it has one of any that many and one more
    often = matched.groupBy("h").agg(F.count("*").alias("files"))
    order = Window.partitionBy("source").orderBy("files", "h")
    rare = known.join(often, "h", "left").withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.floor(F.col("size") * F.lit(1 - CONTAINMENT) + 1e-9) + 1).select("source", "h")
    candidates = matched.join(rare, "h").select("file_id", "source").distinct()
    held = candidates.join(known, "source").join(matched, ["file_id", "h"]).groupBy("file_id", "source", "size").agg(F.countDistinct("h").alias("held"))
    contained = held.withColumn("containment", F.col("held") / F.col("size")).where(F.col("containment") >= CONTAINMENT)
    return contained.groupBy("file_id", F.split("source", " ")[0].alias("source")).agg(F.max("containment").alias("containment"))


def classify(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, path, root_id, class) of the files that aren't hand-written."""

    @F.pandas_udf(T.StringType())
    def made_of(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([composition(c, k) for c, k in zip(content, language)], dtype=object)

    copied = copies(files, upstream).select("file_id").distinct().withColumn("copied", F.lit(True))
    named = F.when(F.col("path").rlike(DEPENDENCY_PATH), "third-party").when(F.col("path").rlike(EMITTED_PATH), "generated").when(F.col("path").rlike(MINIFIED_PATH), "minified")
    rows = spread(files.select("file_id", "path", "root_id", "content")).withColumn("named", named)
    judged = rows.withColumn("class", F.when(F.col("named").isNull() & (F.length("content") > 0), made_of("content", language_of("path"))).otherwise(F.col("named"))).drop("content", "named")
    found = judged.join(copied, "file_id", "left").withColumn("class", F.when(F.col("copied"), F.lit("third-party")).otherwise(F.col("class")))
    return found.where(F.col("class").isNotNull()).select("file_id", "path", "root_id", "class").distinct()
