"""Symbols, references, occurrences, sections and bridge endpoints of source files.

Python files go through the language's own syntax tree; other languages, and
Python that doesn't parse, through line patterns with bracket matching.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

# What opens a definition in the languages read by patterns; the name is the group.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "rs": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:\w+(?:<[^>]*>)?\s+for\s+)?(\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)\s*:")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("constant", r"^const\s+(\w+)\b")],
    "java": [("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\],.]+\s+(\w+)\s*\("), ("constant", r"^\s*(?:public\s+)?static\s+final\s+\w+\s+(\w+)\s*=")],
    "js": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("constant", r"^(?:export\s+)?const\s+(\w+)\b")],
    "c": [("function", r"^(?!typedef|return|else)(?:[A-Za-z_][\w*]*\s+\**)+(\w+)\s*\([^;]*$"), ("struct", r"^(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("constant", r"^static\s+const\s+[\w\s*]+?(\w+)\s*(?:\[\])?\s*=")],
    "py": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^class\s+(\w+)"), ("constant", r"^([A-Z][A-Z0-9_]*)\s*=")],
}
_ACCESS = r"(?:(?:public|private|protected|internal|static|final|sealed|abstract|partial|override|virtual|open|data|async|readonly|inline|suspend|fileprivate|mutating|case|implicit|lazy|external|const|constexpr|extern|friend|explicit)\s+)*"
DEFINITIONS |= {
    "cpp": [("module", r"^\s*namespace\s+([\w:]+)"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)\s*(?:final\s*)?(?::[^;]*)?\{?\s*$"), ("struct", r"^\s*(?:template\s*<[^>]*>\s*)?(?:struct|union)\s+(\w+)\s*(?::[^;]*)?\{?\s*$"), ("enum", r"^\s*enum\s+(?:class\s+)?(\w+)"), ("function", rf"^\s*(?:template\s*<[^>]*>\s*)?{_ACCESS}(?!return|else|throw|new|delete|using|typedef)(?:[\w:]+(?:<[^;(]*>)?[\s*&]+)+(~?[\w:]*\w)\s*\([^;]*$")],
    "cs": [("module", r"^\s*namespace\s+([\w.]+)"), ("class", rf"^\s*{_ACCESS}(?:class|record)\s+(\w+)"), ("struct", rf"^\s*{_ACCESS}struct\s+(\w+)"), ("interface", rf"^\s*{_ACCESS}interface\s+(\w+)"), ("enum", rf"^\s*{_ACCESS}enum\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|internal|static|override|virtual|abstract|async|sealed)\s+)+[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>]*>)?\(")],
    "kt": [("class", rf"^\s*{_ACCESS}(?:class|object)\s+(\w+)"), ("interface", rf"^\s*{_ACCESS}interface\s+(\w+)"), ("enum", rf"^\s*{_ACCESS}enum\s+class\s+(\w+)"), ("function", rf"^\s*{_ACCESS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("), ("constant", r"^\s*const\s+val\s+(\w+)")],
    "swift": [("class", rf"^\s*{_ACCESS}(?:class|actor)\s+(\w+)\s*[:{{<]"), ("struct", rf"^\s*{_ACCESS}struct\s+(\w+)"), ("enum", rf"^\s*{_ACCESS}enum\s+(\w+)"), ("trait", rf"^\s*{_ACCESS}protocol\s+(\w+)"), ("impl", r"^\s*extension\s+(\w+)"), ("function", rf"^\s*{_ACCESS}func\s+(\w+)")],
    "rb": [("module", r"^\s*module\s+([\w:]+)"), ("class", r"^\s*class\s+([\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("constant", r"^\s*([A-Z][A-Z0-9_]+)\s*=")],
    "php": [("class", rf"^\s*{_ACCESS}class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("function", rf"^\s*{_ACCESS}function\s+&?(\w+)\s*\("), ("constant", rf"^\s*{_ACCESS}const\s+(\w+)\s*=")],
    "scala": [("class", rf"^\s*{_ACCESS}class\s+(\w+)"), ("module", rf"^\s*{_ACCESS}object\s+(\w+)"), ("trait", rf"^\s*{_ACCESS}trait\s+(\w+)"), ("function", rf"^\s*{_ACCESS}def\s+(\w+)")],
    "dart": [("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("function", r"^\s*(?:static\s+)?(?:[\w<>?,]+\s+)(?!if\b|for\b|while\b|switch\b)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\(")], "sh": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{?")], "zig": [("function", r"^\s*(?:pub\s+)?(?:export\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*enum\b")],
    "ex": [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)")], "erl": [("function", r"^([a-z]\w*)\s*\([^)]*\)\s*(?:when\b[^-]*)?->")], "hs": [("function", r"^([a-z]\w*)\s*::"), ("type", r"^(?:data|newtype|type)\s+(\w+)"), ("trait", r"^class\s+(?:.*=>\s*)?(\w+)")],
    "jl": [("function", r"^\s*function\s+([\w.!]+)"), ("struct", r"^\s*(?:mutable\s+)?struct\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")], "pl": [("function", r"^\s*sub\s+(\w+)"), ("module", r"^\s*package\s+([\w:]+)")], "r": [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(")],
    "ml": [("function", r"^\s*let\s+(?:rec\s+)?(\w+)\s+[\w(~?]"), ("module", r"^\s*module\s+(\w+)"), ("type", r"^\s*type\s+(?:'\w+\s+)?(\w+)")], "proto": [("struct", r"^\s*message\s+(\w+)"), ("interface", r"^\s*service\s+(\w+)"), ("method", r"^\s*rpc\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)")],
    "sql": [("struct", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`]?([\w.]+)")],
    "hlsl": [("struct", r"^\s*struct\s+(\w+)"), ("constant", r"^\s*cbuffer\s+(\w+)"), ("function", r"^(?!return|else)(?:[A-Za-z_][\w<>]*\s+)+(\w+)\s*\([^;]*$")], "glsl": [("struct", r"^\s*struct\s+(\w+)"), ("function", r"^(?!return|else)(?:[A-Za-z_]\w*\s+)+(\w+)\s*\([^;]*$")],
}
DEFINITIONS |= {alias: DEFINITIONS[own] for own, aliases in {"cpp": "cc cxx hpp hh hxx cu", "kt": "kts", "sh": "bash zsh", "ex": "exs", "ml": "mli", "pl": "pm", "hlsl": "fx usf ush compute", "glsl": "vert frag geom comp wgsl"}.items() for alias in aliases.split()}
#: Languages whose blocks end by indentation or by a word.
INDENTED = frozenset("py rb lua ex exs erl hs jl ml mli r".split())
DEFINITIONS |= {"ts": DEFINITIONS["js"], "h": DEFINITIONS["c"], "tsx": DEFINITIONS["js"], "jsx": DEFINITIONS["js"]}
_PATTERNS = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in DEFINITIONS.items()}
# Names that are no references.
NO_REFERENCE = frozenset("if for while switch return catch function print len range str int float bool list dict set tuple super self this new sizeof typeof void match loop fn def func await async and or not in is".split())
# Where languages meet; the key is the group, or two groups of a route.
ENDPOINTS: list[tuple[str, str, str, str]] = [
    ("tauri_command", "export", "rs", r"#\[tauri::command[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("tauri_command", "import", "js ts", r"\binvoke\s*(?:<[^>]*>)?\(\s*[\"'](\w+)[\"']"),
    ("tauri_event", "export", "rs", r"\.emit(?:_all|_to)?\(\s*\"([\w:-]+)\""), ("tauri_event", "import", "js ts", r"\blisten\s*(?:<[^>]*>)?\(\s*[\"']([\w:-]+)[\"']"),
    ("napi", "export", "rs", r"#\[napi[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("napi", "import", "js ts", r"require\(\s*[\"'][^\"']*\.node[\"']\s*\)\.(\w+)"),
    ("wasm_bindgen", "export", "rs", r"#\[wasm_bindgen[^\]]*\]\s*pub\s+fn\s+(\w+)"), ("wasm_bindgen", "import", "js ts", r"import\s+(?:init,\s*)?\{\s*(\w+)[^}]*\}\s+from\s+[\"'][^\"']*(?:pkg|wasm)[^\"']*[\"']"),
    ("pyo3", "export", "rs", r"#\[pyfunction[^\]]*\]\s*(?:pub\s+)?fn\s+(\w+)"), ("pyo3", "import", "py", r"^from\s+_?\w*native\w*\s+import\s+(\w+)"),
    ("http_route", "export", "rs py js ts go java", r"(?:@\w+|\w*[aA]pp|\w*[rR]outer)\.(get|post|put|delete|patch)\(\s*[\"']([^\"']+)[\"']"), ("http_route", "import", "js ts", r"\bfetch\(\s*[\"'`](?:https?://[^/\"'`]+)?(/[^\"'`?]*)[\"'`](?:\s*,\s*\{\s*method:\s*[\"'](\w+)[\"'])?"),
    ("ffi", "export", "rs", r"#\[(?:unsafe\()?no_mangle\)?\]\s*pub\s+(?:unsafe\s+)?extern\s+\"C\"\s+fn\s+(\w+)"), ("ffi", "import", "c h py", r"\bextern\s+[\w\s*]+?(\w+)\s*\("),
    ("cgo", "export", "c h", r"^(?:[A-Za-z_]\w*\s+\**)+(\w+)\s*\([^;{]*\)\s*[;{]"), ("cgo", "import", "go", r"\bC\.(\w+)\("),
    ("jni", "export", "c h rs", r"\bJava_(\w+)\s*\("), ("jni", "import", "java", r"\bnative\s+[\w<>\[\]]+\s+(\w+)\s*\("),
    ("uniffi", "export", "rs", r"#\[uniffi::export[^\]]*\]\s*pub\s+(?:async\s+)?fn\s+(\w+)"), ("grpc", "export", "proto", r"\brpc\s+(\w+)\s*\("), ("grpc", "import", "py go java js ts", r"\b\w*[sS]tub\.(\w+)\("),
    ("flutter", "export", "java kt swift", r"\bcase\s+\"(\w+)\"\s*:"), ("flutter", "import", "dart", r"\binvokeMethod(?:<[^>]*>)?\(\s*['\"](\w+)['\"]"), ("electron", "export", "js ts", r"\bipcMain\.(?:handle|on)\(\s*[\"']([\w:-]+)[\"']"), ("electron", "import", "js ts", r"\bipcRenderer\.(?:invoke|send)\(\s*[\"']([\w:-]+)[\"']"),
]
_ENDPOINTS = [(kind, role, frozenset(langs.split()), re.compile(p, re.M)) for kind, role, langs, p in ENDPOINTS]


def complexity(node: ast.AST) -> int:
    """1 and one more for each decision."""
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Assert, ast.comprehension))
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        n += max(0, len(x.cases) - 1) if isinstance(x, ast.Match) else 0
    return n


def _tree(text: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_CLEAN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|//[^\n]*|/\*[\s\S]*?\*/")
_DECISION = re.compile(r"\b(?:if|for|while|case|catch|match|loop)\b|&&|\|\||\?(?=[^?.:])")


def symbols(path: str, text: str) -> list[tuple[str, str, str, str, int, int, int]]:
    """(name, kind, container, signature, first line, last line, complexity) of a file."""
    language = path.rsplit(".", 1)[-1].lower()
    lines = text.split("\n")
    out: list = []
    if language == "py" and (tree := _tree(text)) is not None:

        def walk(node: ast.AST, container: str) -> None:
            for x in ast.iter_child_nodes(node):
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(x, ast.ClassDef) else "method" if container else "function"
                    out.append((x.name, kind, container, lines[x.lineno - 1].strip(), x.lineno, x.end_lineno or x.lineno, complexity(x)))
                    walk(x, f"{container}::{x.name}".strip(":"))
                elif isinstance(x, ast.Assign) and isinstance(node, ast.Module):
                    out.extend((t.id, "constant", "", lines[x.lineno - 1].strip(), x.lineno, x.end_lineno or x.lineno, 1) for t in x.targets if isinstance(t, ast.Name) and t.id.isupper())
                elif not isinstance(x, (ast.expr, ast.arguments)):
                    walk(x, container)

        walk(tree, "")
        return out
    patterns = _PATTERNS.get(language)
    if not patterns:
        return []
    bare = _CLEAN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    plain = bare.split("\n")
    depth, depths = 0, []
    for line in plain:
        depths.append(depth)
        depth += line.count("{") - line.count("}")
    open_: list = []
    for n, line in enumerate(plain):
        while open_ and n > open_[-1][1]:
            open_.pop()
        for kind, p in patterns:
            m = p.match(line)
            if not m:
                continue
            end = n
            if kind != "constant" and language not in INDENTED:
                while end + 1 < len(plain) and (depths[end + 1] > depths[n] or end == n and "{" not in line and ";" not in line):
                    end += 1
            elif kind != "constant":
                indent = len(line) - len(line.lstrip())
                while end + 1 < len(plain) and (not plain[end + 1].strip() or len(plain[end + 1]) - len(plain[end + 1].lstrip()) > indent):
                    end += 1
            container = open_[-1][0] if open_ else ""
            body = "\n".join(plain[n : end + 1])
            out.append((m.group(1), "method" if kind == "function" and container else kind, container, lines[n].strip(), n + 1, end + 1, 1 + len(_DECISION.findall(body))))
            if kind in ("impl", "class", "trait", "interface", "struct", "module") and not (kind == "struct" and language in ("c", "h", "go", "rs")):
                open_.append((m.group(1), end))
            break
    return out


_HEIRS = re.compile(r"\b(?:class|interface|struct|trait|object|record|protocol|extension|actor|enum)\s+\w+(?:\s*<[^>{]*>)?(?:\s*\([^)]*\))?\s*(?P<rest>(?:extends|implements|with|:|<(?=\s*\w+\s*$)).*)")
_TYPE_NAME = re.compile(r"(?<![\w.\"'])(?<!class )(?<!struct )(?<!enum )(?<!interface )(?<!trait )(?<!impl )(?<!new )[A-Z]\w*[a-z]\w*\b(?!\s*(?:\(|::|!))")


def _parents(line: str, language: str) -> list[str]:
    """What a type's declaration names as its parents or interfaces; in Ruby what a module mixes in, too."""
    if language == "rb" and (m := re.match(r"\s*(?:include|extend|prepend)\s+(\w+)", line)):
        return [m.group(1)]
    m = _HEIRS.search(line)
    if not m:
        return []
    rest = re.sub(r"<[^<>]*>|\([^()]*\)|\{.*", " ", m.group("rest"))
    return [w for w in re.findall(r"\b[A-Za-z_]\w*", rest) if w not in ("extends", "implements", "with", "public", "private", "protected", "virtual", "where", "final")]


def references(path: str, text: str) -> list[tuple[str, int, str]]:
    """(name, line, kind) of the calls and imports of a file."""
    language = path.rsplit(".", 1)[-1].lower()
    if language == "py" and (tree := _tree(text)) is not None:
        out = []
        for x in ast.walk(tree):
            if isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else None
                if name and name not in NO_REFERENCE:
                    out.append((name, x.lineno, "calls"))
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                out += [(a.name.rsplit(".", 1)[-1], x.lineno, "imports") for a in x.names]
            elif isinstance(x, ast.ClassDef):
                out += [(b.id, x.lineno, "implements") for b in x.bases if isinstance(b, ast.Name)]
        return out
    bare = _CLEAN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out = []
    for n, line in enumerate(bare.split("\n"), 1):
        if re.match(r"\s*(?:use|import|#include|const \w+ = require)\b", line):
            out += [(w, n, "imports") for w in re.findall(r"\b([A-Z]\w+|\w+)\b(?=\s*(?:[;}]|$))", line)[-1:]]
            continue
        if m := re.match(r"\s*impl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\s+\w+", line):
            out.append((m.group(1), n, "implements"))
        out += [(name, n, "implements") for name in _parents(line, language)]
        out += [(m.group(), n, "uses") for m in _TYPE_NAME.finditer(line)]
        out += [(m.group(1), n, "calls") for m in re.finditer(r"(?<![\w.])(?:\w+(?:::|\.))*(\w+)\s*\(", line) if m.group(1) not in NO_REFERENCE and not re.search(r"\b(?:fn|def|func|function|long|public|static)\b[^(]*$", line[: m.start(1)])]
    return out


def occurrences(path: str, text: str) -> list[tuple[str, int, int, int, int]]:
    """(name, line, column, first byte, end byte) of the identifiers of a file; columns are characters."""
    starts, total = [], 0
    for line in text.split("\n"):
        starts.append(total)
        total += len(line.encode()) + 1
    if path.endswith(".py"):
        try:
            found = [(t.string, t.start[0], t.start[1]) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.NAME and t.string not in NO_REFERENCE]
        except (tokenize.TokenError, SyntaxError, IndentationError):
            found = []
    else:
        bare = _CLEAN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        found = [(m.group(), n, m.start()) for n, line in enumerate(bare.split("\n"), 1) for m in re.finditer(r"[^\W\d]\w*", line)]
    lines = text.split("\n")
    out = []
    for name, line, col in found:
        b = starts[line - 1] + len(lines[line - 1][:col].encode())
        out.append((name, line, col, b, b + len(name.encode())))
    return out


def endpoints(path: str, text: str) -> list[tuple[str, str, str, int]]:
    """(kind, role, key, line) where a file meets another language."""
    language = path.rsplit(".", 1)[-1].lower()
    out = []
    for kind, role, languages, pattern in _ENDPOINTS:
        if language not in languages:
            continue
        for m in pattern.finditer(text):
            key = m.group(1)
            if kind == "http_route":
                method, route = (m.group(1), m.group(2)) if role == "export" else (m.group(2) or "GET", m.group(1))
                route = route.strip().lower()
                key = f"{method.upper()} {route.rstrip('/') or '/'}"
            out.append((kind, role, key, text.count("\n", 0, m.start()) + 1))
    return out


def _read(files: DataFrame, parse: Callable, columns: str) -> DataFrame:
    names = ["path", *[c.strip().split(" ")[0] for c in columns.split(",")]]
    source = spread(files.select("path", "content").where("length(content) > 0 and path is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(batch["path"], batch["content"]) for r in parse(p, t)], columns=names)

    return source.mapInPandas(run, f"path string, {columns}")


def read_symbols(files: DataFrame) -> DataFrame:
    return _read(files, symbols, "name string, kind string, container string, signature string, line_start int, line_end int, complexity int")


def read_references(files: DataFrame) -> DataFrame:
    return _read(files, references, "name string, line int, kind string")


def read_occurrences(files: DataFrame) -> DataFrame:
    return _read(files, occurrences, "name string, line int, col int, byte_start int, byte_end int")


def read_endpoints(files: DataFrame) -> DataFrame:
    return _read(files, endpoints, "kind string, role string, binding_key string, line int")


def read_sections(files: DataFrame, budget: int = 256) -> DataFrame:
    """(path, position, depth, heading, line_start, line_end, text): one overview and one section a symbol; long symbols are cut at lines of least indentation.

    A file without symbols is its whole text, cut the same way.
    """

    def parts(lines: list[str], a: int, b: int) -> Iterator[tuple[int, int]]:
        begin = a
        while begin <= b:
            end, words, best = begin, 0, None
            while end <= b:
                words += len(lines[end - 1].split())
                if words > budget and end > begin:
                    break
                indent = len(lines[end - 1]) - len(lines[end - 1].lstrip())
                if lines[end - 1].strip() and end > begin and (best is None or indent <= best[0]):
                    best = (indent, end)
                end += 1
            stop = b if end > b else (best[1] - 1 if best and best[1] > begin + 1 else end - 1)
            yield begin, stop
            begin = stop + 1

    def cut(path: str, text: str) -> Iterator[tuple]:
        lines, title = text.split("\n"), path.rsplit("/", 1)[-1]
        found = [s for s in symbols(path, text) if s[1] != "constant"]
        if not found:
            for n, (begin, stop) in enumerate(parts(lines, 1, len(lines))):
                yield n, 1, title, begin, stop, "\n".join(lines[begin - 1 : stop])
            return
        yield 0, 1, title, 1, len(lines), "\n".join(s[3] for s in found)
        n = 0
        for name, _, container, _, a, b, _ in found:
            for begin, stop in parts(lines, a, b):
                n += 1
                yield n, 2, f"{container}::{name}".strip(":"), begin, stop, "\n".join(lines[begin - 1 : stop])

    return _read(files, cut, "position int, depth int, heading string, line_start int, line_end int, text string")


_MANIFESTS = {"Cargo.toml": "rust", "package.json": "node", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "pom.xml": "java", "build.gradle": "java", "pubspec.yaml": "dart", "Gemfile": "ruby", "composer.json": "php"}


def packages(paths: DataFrame) -> DataFrame:
    """(folder, ecosystem) of the manifests among paths (path)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    eco = F.create_map(*[x for k, v in _MANIFESTS.items() for x in (F.lit(k), F.lit(v))])[name]
    return paths.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), eco.alias("ecosystem")).where("ecosystem is not null").distinct()
