"""Functions paired with their documentation (problem 6).

Whole files are parsed by :mod:`items`.  Headers are parsed with one ambiguous,
left-recursive grammar for the languages of the corpus, by an error-recovering
generalised LL parser; a broken header still gives its name and the parameters
that can be read.  Of the
documentation everything is taken away that the header already says, that is
markup, or that is a note about documentation; what is left must say something.
Descriptions that many functions of the corpus share word for word, and that
are too short to say anything, are found by their hash counts and dropped too.

Defined results: a null or empty description is no description; exact duplicate
rows give one pair; ``kind`` is compared without case and blanks; a null
signature gives a pair without parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import items
from lodestrata.llm.gll import Grammar, Parser
from lodestrata.session import settle, spread

#: A description is a template of the corpus if at least so many names and this share of the described functions have it.
TEMPLATE_NAMES, TEMPLATE_SHARE, TEMPLATE_WORDS = 5, 0.0005, 5

_TOKEN = regex.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\#(?!\[)[^\n]*)|(?P<str>[bruRf]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*'|`[^`]*(?:`|\Z)))"
    r"|(?P<life>'[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<id>[\p{L}_$][\p{L}\p{N}_$]*)|(?P<op>->|=>|::|\.\.\.|&&|\|\||[^\s])",
    regex.S,
)
_KEYWORDS = frozenset("fn def func function fun sub".split())
_MODIFIERS = frozenset("pub public private protected internal static final async export default extern unsafe const inline abstract override virtual synchronized native crate open suspend get set constexpr mut".split())

#: Headers; "id" is any identifier, "word" one that is no keyword, "inner" any token but brackets and commas.
HEADER: Grammar = {
    "Header": [["Prefix", "Core", "Tail"]],
    "Prefix": [[], ["Prefix", "modifier"], ["Prefix", "@", "id", "Arguments"], ["Prefix", "@", "id"], ["Prefix", "#", "Square"], ["Prefix", "modifier", "Round"], ["Prefix", "modifier", "str"]],
    "Core": [["func", "Receiver", "Name", "Generic", "GoParameters"], ["keyword", "Receiver", "Star", "Name", "Generic", "Parameters"], ["Type", "Name", "Generic", "Parameters"], ["Name", "Generic", "Parameters"]],
    "Star": [[], ["*"]],
    "Receiver": [[], ["Round"]],
    "Name": [["word"], ["word", "::", "Name"], ["word", ".", "Name"]],
    "Generic": [[], ["Angle"], ["Square"]],
    "Parameters": [["(", ")"], ["(", "List", ")"], ["(", "List", ",", ")"]],
    "GoParameters": [["(", ")"], ["(", "GoList", ")"], ["(", "GoList", ",", ")"]],
    "GoList": [["GoParameter"], ["GoList", ",", "GoParameter"]],
    "GoParameter": [["Ident", "Type"], ["Ident"], ["Ident", "...", "Type"]],
    "List": [["Parameter"], ["List", ",", "Parameter"]],
    "Parameter": [
        ["Ident", "Default"], ["Ident", ":", "Type", "Default"], ["Ident", "?", ":", "Type", "Default"], ["Type", "Ident", "Default"], ["Ident", "Type"], ["Ident", "...", "Type"],
        ["Marker", "Parameter"], ["*"], ["/"], ["Curly", "Annotation", "Default"], ["Square", "Annotation", "Default"], ["self"], ["Ident", "Square"], ["Type", "Ident", "Square"],
    ],
    "Annotation": [[], [":", "Type"]],
    "Marker": [["*"], ["*", "*"], ["&"], ["..."], ["modifier"], ["@", "id"], ["life"]],
    "Ident": [["word"]],
    "Default": [[], ["=", "Expression"]],
    "Type": [["TypePart"], ["Type", "TypePart"]],
    "TypePart": [["id"], ["life"], ["str"], ["num"], ["Angle"], ["Square"], ["Round"], ["Curly"], ["*"], ["&"], ["&&"], ["|"], ["."], ["::"], ["->"], ["=>"], ["?"], ["!"], ["+"], ["modifier"]],
    "Expression": [["Item"], ["Expression", "Item"]],
    "Item": [["inner"], ["Round"], ["Square"], ["Curly"]],
    "Round": [["(", ")"], ["(", "Group", ")"]],
    "Square": [["[", "]"], ["[", "Group", "]"]],
    "Curly": [["{", "}"], ["{", "Group", "}"]],
    "Angle": [["<", "AngleGroup", ">"]],
    "Arguments": [["Round"]],
    "Group": [["GroupItem"], ["Group", "GroupItem"]],
    "GroupItem": [["inner"], [","], ["Round"], ["Square"], ["Curly"]],
    "AngleGroup": [["AngleItem"], ["AngleGroup", "AngleItem"]],
    "AngleItem": [["id"], ["life"], [","], [":"], ["+"], ["="], ["?"], ["&"], ["*"], ["|"], ["."], ["::"], ["num"], ["str"], ["Angle"], ["Square"], ["Round"], ["->"]],
    "Tail": [[], ["Tail", "tail"]],
}
_parser = Parser(HEADER)
_names: dict[tuple[str, str], frozenset[str]] = {}


def _answers(kind: str, text: str) -> frozenset[str]:
    """The terminals that a token matches."""
    key = (kind, text if kind in ("op", "id") else "")
    if key not in _names:
        out = {kind, "tail"}
        if kind == "op":
            out.add(text)
        if kind == "id":
            if text == "func":
                out.add("func")
            out.add("keyword" if text in _KEYWORDS else "modifier" if text in _MODIFIERS else "word")
            if text in ("get", "set", "default", "open", "sub", "fun"):
                out.add("word")
            if text in ("self", "this", "cls"):
                out.add("self")
        if text not in ("(", ")", "[", "]", "{", "}", ","):
            out.add("inner")
        if len(_names) > 200_000:
            _names.clear()
        _names[key] = frozenset(out)
    return _names[key]


@lru_cache(maxsize=50_000)
def _shape(classes: tuple[frozenset[str], ...]) -> tuple[int, tuple[int, ...], int]:
    """(place of the name, places of the parameters, repairs) in a sequence of token classes; -1 where there is none."""
    parse = _parser.parse(list(classes), "Header")
    root = parse.derive("Header", 0, len(classes)) if parse else None
    if root is None:
        return -1, (), parse.cost if parse else -1
    found: list[int] = []
    name: list[int] = []

    def walk(node: list, inside: bool) -> None:
        if node[0] == "Name" and not name:
            name.extend(k for k in range(node[1], node[2])[-1:] if "id" in classes[k])
        if node[0] in ("Parameter", "GoParameter"):
            inside = True
        if node[0] == "Ident" and inside:
            found.extend(k for k in range(node[1], node[2])[:1] if "id" in classes[k])
            return
        for child in node[3]:
            if isinstance(child, list) and child[0] not in ("Type", "Expression", "Tail", "Prefix"):
                walk(child, inside)

    walk(root, False)
    return (name[0] if name else -1), tuple(found), parse.cost


def header(signature: str | None) -> tuple[str | None, list[str], int]:
    """(name, parameter names, repairs) of a function header; (None, [], -1) if none can be read.

    The parse depends on token classes only, so headers of one shape share it.
    """
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(signature or "") if m.lastgroup != "skip"]
    if not tokens:
        return None, [], -1
    name, parameters, cost = _shape(tuple(_answers(k, t) for k, t in tokens))
    return (tokens[name][1] if name >= 0 else None), [tokens[k][1] for k in parameters], cost


# --- descriptions -----------------------------------------------------------

_MARKER = regex.compile(r"^\s*(?:/\*\*?|\*/|\*+(?!\*)|//[/!]?|--+\s|;;+|#+!?\s|#$|\"\"\"|'''|<!--|-->|%+\s)\s?|\s*(?:\*/|\"\"\"|'''|-->)\s*$")
_TAG = regex.compile(r"^(?:[@\\:](?P<tag>param(?:eter)?|arg(?:ument)?|type|tparam|return|returns|rtype|throws|raises|exception|since|see|author|version|deprecated|todo|example|yield|yields)\b:?)\s*(?P<rest>.*)$", regex.I)
_XMLTAG = regex.compile(r"</?(?:summary|param|returns|remarks|para|c|p|code|see|typeparam|value)\b[^<>]*>", regex.I)
_WORDS = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")
# Words that say nothing beside a restated name.
_EMPTY = frozenset(
    "a an the this that these it its is are be of for to in on and or with by from function method procedure routine helper utility wrapper implementation constructor getter setter does do will simply just performs perform used use which given provided specified value values parameter parameters param argument arguments arg return returns returned result results main method"
    " der die das den dem ein eine einer und oder von zu für funktion methode le la les un une des du de et ou pour fonction méthode el los las una y o para función método".split()
)
# Notes that stand in for a description.
_STUB = frozenset(
    "todo|fixme|xxx|tbd|tba|wip|hack|n/a|na|none|(none)|nil|null|description|descr|desc|doc|docs|documentation|undocumented|no description|no docs|no documentation|no comment|docs go here|doc goes here|description goes here|description here|document this|document me|todo document this"
    "|todo add docs|fixme add docs|add docs|add documentation|write docs|write me|missing docs|missing documentation|needs docs|needs documentation|internal|internal use|internal use only|private|lorem ipsum|auto generated method stub|autogenerated method stub|auto generated|autogenerated|autogenerated stub|method stub|stub|placeholder"
    "|helper function|helper|helper method|utility function|function|method|to do|to be done|to be documented|to be written|coming soon|not documented|not documented yet|work in progress|self explanatory|obvious|test|foo|bar|asdf|insert description here|enter description here|your description here|summary|some function|does stuff|does something|misc".split("|")
)
_NOTE = regex.compile(r"^(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|NOTE TO SELF)\b\s*(?:\([^)]*\)|\[[^\]]*\])?\s*(?:[:\-–—!].*)?[.!]*$", regex.I)
_INHERIT = regex.compile(r"^\W*(?:@?inherit(?:ed)?(?:[ -]?doc(?:umentation)?)?|@override|overrides? (?:super|parent)\w*|inherited from \S+)\W*$", regex.I)
_DIRECTIVE = regex.compile(
    r"^[@\-*!#\s]*(?:noqa|nosec|nolint|nosonar|type:\s*ignore|pylint|pyright|mypy|flake8|ruff|isort|yapf|fmt|black|pragma|coverage|eslint|tslint|jshint|jslint|prettier|istanbul|c8|ts-(?:ignore|expect-error|nocheck)|biome|stylelint|clippy|rustfmt|rustdoc|allow\(|deny\(|cfg\(|go:\w+|lint:|golint|golangci|gofmt|staticcheck|checkstyle|spotbugs|suppresswarnings|suppress|spotless|pmd|clang-format|clang-tidy|cppcheck|nolintnextline|iwyu|doxygen|swiftlint|rubocop|codeql|sonar\w*|region|endregion|vim|emacs|-\*-)\b.*$",
    regex.I,
)
_POINTER = regex.compile(r"^(?:please\s+)?(?:see|see also|cf\.?|refer to|same as|as in|like in|documented in|described in|ditto|look at|check|consult|siehe|voir|véase|ver|см\.)\b:?\s*(?P<rest>.*)$", regex.I)
_POINTER_WORDS = frozenset("for more details detail info information documentation docs the a in of at to on above below also description description. here there elsewhere file module class function method source code spec interface trait base parent super and its it this next previous page wiki readme link section".split())
_CODE_LINE = regex.compile(
    r"^(?:[\w.\[\]\"'*&]+\s*(?:[+\-*/%|&^]|<<|>>|:)?=(?!=)\s*\S.*|(?:let|var|const|auto|int|long|double|float|bool|char|String)\s+\w+.*[=;].*|return\b(?:\s+[^\s]*[\d_.()\[\]+*/\-<>=].*|\s+\w+)?;?|return\s+.*;|.*[;{}]\s*$|(?:if|for|while|switch|elif|else if)\b\s*[(\w].*[:{)]\s*$|else\s*[:{]?|[\w.]+\((?:[^()]|\([^()]*\))*\)\s*;?|import\s+[\w.*{}, ]+(?:\s+from\s+\S+)?;?|from\s+\S+\s+import\s+.*|print\s*[(\"'].*|#include\s.*|@\w+(?:\(.*\))?|(?:pub\s+)?(?:fn|def|func|function|class|struct)\s+\w+.*[({:].*)$"
)


def _stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 3 or not w.isascii():
        return w
    for end, put in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("ing", ""), ("ed", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 2 and not w.endswith("ss"):
            w = w[: -len(end)] + put
            break
    w = w.rstrip("e") if len(w) > 3 else w
    w = w[:-1] + "i" if w.endswith("y") else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _split(name: str) -> list[str]:
    return regex.findall(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?[\p{Ll}\p{M}\p{Lo}]+|\p{Lu}+|\p{N}+", name)


def _clean(doc: str) -> list[str]:
    """Lines of a description without comment markers and rules."""
    out = []
    for line in doc.replace("\r", "").split("\n"):
        before = None
        while before != line:
            before, line = line, _MARKER.sub("", line)
        line = _XMLTAG.sub(lambda m: m.group() if "inherit" in m.group().lower() else " ", line).strip()
        if regex.search(r"[\p{L}\p{N}]", line):
            out.append(line)
    return out


def _says(text: str, known: set[str]) -> bool:
    """Whether a text has a word besides those known and the empty ones."""
    return any(w.lower() not in _EMPTY and _stem(w) not in known and w.lower() not in known for w in _WORDS.findall(regex.sub(r"(?<=\p{Ll})(?=\p{Lu})", " ", text)))


def content(doc: str | None, name: str, parameters: list[str]) -> str:
    """What a description says besides name and parameters; empty if it is trivial."""
    if not doc or not doc.strip():
        return ""
    parts = [w for n in [name, *parameters] for w in _split(n)]
    known = {_stem(w) for w in parts} | {w.lower() for w in parts} | {n.lower() for n in [name, *parameters]}
    kept = []
    for line in _clean(doc):
        tag = _TAG.match(line)
        if tag:
            rest = tag.group("rest")
            if tag.group("tag").lower() in ("see", "author", "since", "version", "todo"):
                continue
            rest = regex.sub(r"^(?:\{[^}]*\}\s*)?[\w$*.\[\]]+\s*:?", lambda m: m.group() if tag.group("tag").lower() in ("return", "returns", "deprecated", "yield", "yields") else "", rest)
            if _says(rest, known) and regex.sub(r"[^\p{L}\p{N}]+", " ", rest).strip().lower() not in _STUB:
                kept.append(rest)
            continue
        plain = regex.sub(r"[^\p{L}\p{N}/()]+", " ", line).strip().lower()
        if plain in _STUB or _NOTE.match(line) or _INHERIT.match(line) or _DIRECTIVE.match(line) or regex.fullmatch(r"\W*inheritdoc\W*", line, flags=regex.I):
            continue
        pointer = _POINTER.match(line)
        if pointer:
            rest = regex.sub(r"https?://\S+|`[^`]*`|\{@link [^}]*\}|\[[^\]]*\](?:\([^)]*\))?", " ", pointer.group("rest"))
            words = [w for w in regex.findall(r"[^\s,;:()]+", rest) if w.strip(".!").lower() not in _POINTER_WORDS and w.strip(".")]
            if len(words) <= 1 or all(regex.search(r"[_.#:/]|\p{Ll}\p{Lu}|\d", w) for w in words):
                continue
        if _CODE_LINE.match(line) and not regex.search(r"\p{L}+ \p{L}+ \p{L}+ \p{L}+ \p{L}+", line):
            continue
        if _says(line, known):
            kept.append(line)
    return "\n".join(kept)


def pairs(symbols: DataFrame) -> DataFrame:
    """Rows (symbol_id, file_path, kind, name, parameters, repairs, signature, description, content) of functions that are described.

    Parsing is a narrow pass; the only shuffles are the removal of exact
    duplicates and the hash counts of short descriptions, pre-aggregated.
    """
    source = (
        symbols.select(F.col("id").alias("symbol_id"), "file_path", F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), r"\s+", "")).alias("kind"), F.coalesce("name", F.lit("")).alias("name"), "signature", "doc_comment")
        .where(F.col("kind").isin("function", "method") & (F.length(F.trim("doc_comment")) > 0))
        .dropDuplicates()
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                sig = r.signature or ""
                read, parameters, cost = header(sig)
                text = content(r.doc_comment, r.name or read or "", parameters)
                if text:
                    rows.append((r.symbol_id, r.file_path, r.kind, r.name, parameters, cost, r.signature, r.doc_comment, text, len(_WORDS.findall(text))))
            yield pd.DataFrame(rows, columns=["symbol_id", "file_path", "kind", "name", "parameters", "repairs", "signature", "description", "content", "n_words"])

    shape = "symbol_id string, file_path string, kind string, name string, parameters array<string>, repairs int, signature string, description string, content string, n_words int"
    return without_templates(spread(source).mapInPandas(run, shape)).drop("n_words")


def without_templates(described: DataFrame) -> DataFrame:
    """Rows (name, content, n_words, …) but for those whose short description many names share word for word, by exact counts of hashes."""
    described = settle(described.withColumn("content_hash", F.xxhash64(F.lower(F.regexp_replace("content", r"[^\p{L}\p{N}]+", " ")))))
    total = described.count()
    short = described.where(f"n_words <= {TEMPLATE_WORDS} and not content rlike '[\\\\p{{N}}\\\\p{{IsHan}}\\\\p{{IsHiragana}}\\\\p{{IsThai}}]'")
    shared = short.select("content_hash", "name").distinct().groupBy("content_hash").agg(F.count("*").alias("names"))
    templates = shared.where((F.col("names") >= TEMPLATE_NAMES) & (F.col("names") >= TEMPLATE_SHARE * total))
    return described.join(templates, "content_hash", "left_anti").drop("content_hash")


# --- functions in files ---------------------------------------------------------

_COMMENT_BEFORE = regex.compile(r"[ \t]*(?://|\#|@\w)")
_DOCSTRING = regex.compile(r"\s*[rRuU]?(\"\"\"|\'\'\')([\s\S]*?)(?:\1|\Z)")


def _doc_before(text: str, start: int) -> str:
    """The comments and annotations on the lines right before a place."""
    at = start = text.rfind("\n", 0, start) + 1
    while at > 0:
        begin = text.rfind("\n", 0, at - 1) + 1
        if text[begin:at].rstrip().endswith("*/") and not _COMMENT_BEFORE.match(text, begin, at):
            opened = text.rfind("/*", 0, at)
            begin = text.rfind("\n", 0, max(0, opened)) + 1
            if opened < 0 or text[begin:opened].strip():
                break
        elif not _COMMENT_BEFORE.match(text, begin, at):
            break
        at = begin
    return text[at:start]


def functions(path: str, text: str) -> Iterator[tuple[str, int, int, str, str, list[str], int, bool]]:
    """(name, first line, last line, header, documentation, parameters, repairs, complete) of the functions in a file, valid or not."""
    language = path.rsplit(".", 1)[-1].lower()
    for f in items.functions(text, language):
        head = text[f.start : f.head].strip().removesuffix(":")
        name, parameters, cost = header(head)
        if (cost or name != f.name) and f.params is not None:  # an assigned function: its parameters by themselves
            short = header(f.name + text[f.params.start : f.params.end])
            if name != f.name or 0 <= short[2] < cost:
                parameters, cost = short[1:]
        inner = _DOCSTRING.match(text, f.body) if language == "py" else None
        doc = inner.group(2) if inner else _doc_before(text, f.start)
        yield f.name, text.count("\n", 0, f.start) + 1, text.count("\n", 0, max(f.start, f.end - 1)) + 1, head, doc, parameters, max(cost, f.repairs), f.complete and cost == 0


def file_pairs(files: DataFrame) -> DataFrame:
    """Rows (path, name, line_start, line_end, signature, description, parameters, repairs, complete) of documented functions read from source files, damaged ones included."""
    source = spread(files.select("path", F.col("content").alias("_text")).where("length(_text) > 0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["_text"]):
                for name, a, b, head, doc, parameters, cost, complete in functions(path or "", text):
                    said = content(doc, name, parameters)
                    if said:
                        rows.append((path, name, a, b, head, said, parameters, cost, complete, len(_WORDS.findall(said))))
            yield pd.DataFrame(rows, columns=["path", "name", "line_start", "line_end", "signature", "content", "parameters", "repairs", "complete", "n_words"])

    shape = "path string, name string, line_start int, line_end int, signature string, content string, parameters array<string>, repairs int, complete boolean, n_words int"
    return without_templates(source.mapInPandas(run, shape)).select("path", "name", "line_start", "line_end", "signature", F.col("content").alias("description"), "parameters", "repairs", "complete")
