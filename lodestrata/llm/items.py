"""Functions of whole source files, valid or not, by generalised LL parsing (problem 6).

A file is read into tokens and nested into bracket groups; brackets that don't
match are repaired where they stand.  Each group is a sequence of statements,
and every statement is parsed with the function grammar of its language over
token classes, in which an inner group is one terminal, so a statement that
recurs is parsed once.  A function is a node of such a parse; its body is the
group at the node, and it is complete if neither its header nor anything inside
it was repaired and the body follows the statement productions of the language.
"""

from __future__ import annotations

import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from lodestrata.llm.gll import Grammar, Parser
from lodestrata.llm.lexers import lex
from lodestrata.llm.syntax import group_valid, permitted_pairs

#: Repairs that a statement which begins like a function may take.
REPAIRS = 2

_NOTES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _CHAR, _SINGLE = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)", r"'(?:\\(?:u\{[^}\n]*\}|[^\n])[^'\n]{0,8}|[^'\\\n])'", r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_TRIPLE = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)"
_TEXTS = {
    "py": (r"\#[^\n]*", rf"[bBrRuUfF]{{0,2}}(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE})"), "rs": (_NOTES, rf"b?r(?P<h>\#*)\".*?(?:\"(?P=h)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?{_CHAR}"), "go": (_NOTES, rf"{_DOUBLE}|`[^`]*(?:`|\Z)|{_CHAR}"),
    "js": (_NOTES, rf"{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*(?:`|\Z)|(?<=[(,=:\[!&|?{{}};\n][ \t]*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"), "java": (_NOTES, rf"\"\"\".*?(?:\"\"\"|\Z)|{_DOUBLE}|{_CHAR}"),
    "c": (_NOTES + r"|(?m:^[ \t]*\#(?:\\\r?\n|[^\n])*)", rf"{_DOUBLE}|{_CHAR}"),
}
_SCAN = {
    k: regex.compile(rf"(?P<skip>[^\S\n]+|{note})|(?P<nl>\n)|(?P<str>{text})|(?P<life>'[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<id>[\p{{L}}_$][\p{{L}}\p{{N}}_$]*)|(?P<op>->|=>|::|\.\.\.|\S)", regex.S)
    for k, (note, text) in _TEXTS.items()
}
_FAMILY = {"ts": "js", "h": "c"}
_START = {"py": "Python", "rs": "Rust", "go": "Go", "js": "Script", "java": "Java", "c": "C"}

_OPEN, _CLOSE = {"(": "Round", "[": "Square", "{": "Curly"}, {")": "Round", "]": "Square", "}": "Curly"}
# Words of the languages by what they do in a function's header.
_WORDS = {
    w: k
    for k, words in {
        "fn": "fn def function fun", "func": "func", "declare": "const let var", "tag": "struct enum union interface chan map", "throws": "throws", "where": "where",
        "mod": "pub public private protected internal static final async export default extern unsafe inline abstract override virtual synchronized native register volatile readonly declare constexpr mut dyn impl get set strictfp",
        "control": "if for while switch match return else do try catch finally new throw case typeof await yield delete loop class import package use typedef namespace elif with except lambda raise assert select go defer range from",
    }.items()
    for w in words.split()
}
_ALSO_NAMES = frozenset("get set default static async declare from map go with match select range use assert open import delete".split())

_REST: list[list[str]] = [["any"], ["Rest", "any"]]
GRAMMAR: Grammar = {
    "Attributes": [[], ["Attributes", "@", "Dotted"], ["Attributes", "@", "Dotted", "Round"], ["Attributes", "#", "Square"], ["Attributes", "#", "!", "Square"], ["Attributes", "mod"], ["Attributes", "mod", "Round"], ["Attributes", "mod", "str"]],
    "Dotted": [["word"], ["Dotted", ".", "word"]],
    "Name": [["word"]],
    "Params": [["Round"]],
    "Body": [["Curly"]],
    "Star": [[], ["*"]],
    "Generic": [[], ["Angle"], ["Square"]],
    "Angle": [["<", "Angled", ">"]],
    "Angled": [["In"], ["Angled", "In"]],
    "In": [["word"], ["mod"], ["tag"], ["declare"], ["life"], ["num"], ["str"], [","], [":"], ["+"], ["="], ["?"], ["&"], ["*"], ["|"], ["."], ["::"], ["->"], ["=>"], ["Angle"], ["Square"], ["Round"], ["Curly"]],
    "Type": [["Part"], ["Type", "Part"]],
    "Part": [["word"], ["mod"], ["declare"], ["tag"], ["tag", "Curly"], ["life"], ["num"], ["str"], ["Angle"], ["Square"], ["*"], ["&"], ["::"], ["."], ["?"], ["!"], ["+"], ["|"]],
    "Wide": [["Part"], ["Round"], ["->"], ["=>"], ["fn"], ["func"], ["="], ["-"], ["Wide", "Part"], ["Wide", "Round"], ["Wide", "->"], ["Wide", "=>"], ["Wide", "fn"], ["Wide", "func"], ["Wide", "="], ["Wide", "-"]],
    "Result": [[], ["->", "Wide"]],
    "Where": [[], ["where", "Bounds"]],
    "Bounds": [["Bound"], ["Bounds", "Bound"]],
    "Bound": [["Wide"], [":"], [","], ["for"]],
    "Rust": [["Attributes", "Const", "fn", "Name", "Generic", "Params", "Result", "Where", "Body"]],
    "Const": [[], ["declare"], ["declare", "Attributes"]],
    "Go": [["func", "Name", "Generic", "Params", "Returned", "Body"], ["func", "Round", "Name", "Generic", "Params", "Returned", "Body"]],
    "Returned": [[], ["Wide"]],
    "Script": [
        ["Attributes", "fn", "Star", "Name", "Generic", "Params", "Note", "Body"], ["Attributes", "Star", "Member", "Generic", "Params", "Note", "Body"], ["Attributes", "declare", "Name", "Note", "=", "Attributes", "Lambda"],
        ["Attributes", "Member", "Note", "=", "Attributes", "Lambda"], ["Member", ":", "Attributes", "Lambda"], ["Dotted", ".", "Name", "=", "Attributes", "Lambda"],
    ],
    "Member": [["Name"], ["str"], ["Square"]],
    "Note": [[], [":", "Kind"]],
    "Kind": [["Wide"], ["Curly"], ["Kind", "Wide"], ["Kind", "Curly"]],
    "Lambda": [["fn", "Star", "Params", "Note", "Body"], ["fn", "Star", "word", "Params", "Note", "Body"], ["Generic", "Params", "Note", "=>", "Body"], ["Generic", "Params", "Note", "=>", "Rest"], ["word", "=>", "Body"], ["word", "=>", "Rest"]],
    "Rest": _REST,
    "Java": [["Attributes", "Generic", "Type", "Name", "Params", "Throws", "Body"], ["Attributes", "Generic", "Name", "Params", "Throws", "Body"]],
    "Throws": [[], ["Square"], ["throws", "Thrown"]],
    "Thrown": [["Type"], ["Thrown", ",", "Type"]],
    "C": [["Attributes", "Type", "Name", "Params", "Body"]],
    "Python": [["Attributes", "fn", "Name", "Generic", "Params", "Result", ":"], ["Attributes", "fn", "Name", "Generic", "Params", "Result", ":", "Rest"]],
}
_parser = Parser(GRAMMAR)


@dataclass
class Node:
    """A token, or a bracket group with what stands in it."""

    kind: str
    text: str
    start: int
    end: int
    fresh: bool = False
    inner: list["Node"] = field(default_factory=list)
    closed: bool = True
    #: Repairs of brackets at or inside the group.
    repairs: int = 0


def _tokens(text: str, family: str) -> Iterator[Node]:
    fresh = True
    for m in _SCAN[family].finditer(text):
        kind = m.lastgroup
        if kind == "nl":
            fresh = True
        elif kind != "skip":
            yield Node(kind, m.group() if kind in ("id", "op") else "", m.start(), m.end(), fresh)
            fresh = False


_FRESH_PYTHON = frozenset("def class import from async return @".split())


def nest(text: str, family: str) -> Node:
    """The bracket tree of a file.

    A closing bracket ends the groups that stand open inside its own; one without
    its own is left out.  A parenthesis that is never closed ends before its first
    brace; in Python any bracket does before a line that begins a definition.
    """
    root = Node("File", "", 0, len(text))
    stack = [root]

    def end(at: int, closed: bool) -> None:
        group = stack.pop()
        group.end, group.closed = at, closed
        above = stack[-1]
        if not closed:
            group.repairs += 1
            brace = next((k for k, x in enumerate(group.inner) if x.kind == "Curly"), None) if group.kind == "Round" and family != "py" else None
            if brace is not None:
                above.inner += group.inner[brace:]
                group.inner = group.inner[:brace]
                group.end = group.inner[-1].end if group.inner else group.start + 1
        above.repairs += group.repairs

    for t in _tokens(text, family):
        if family == "py" and t.fresh and t.text in _FRESH_PYTHON and len(stack) > 1:
            while len(stack) > 1:
                end(t.start, False)
        if t.text in _OPEN:
            group = Node(_OPEN[t.text], "", t.start, t.end, t.fresh)
            stack[-1].inner.append(group)
            stack.append(group)
        elif t.text in _CLOSE:
            if any(g.kind == _CLOSE[t.text] for g in stack[1:]):
                while stack[-1].kind != _CLOSE[t.text]:
                    end(t.start, False)
                end(t.end, True)
            else:
                stack[-1].repairs += 1
        else:
            stack[-1].inner.append(t)
    while len(stack) > 1:
        end(len(text), False)
    return root


def _class(n: Node) -> frozenset[str]:
    return _classes(n.kind, n.text)


@lru_cache(maxsize=10_000)
def _classes(kind: str, text: str) -> frozenset[str]:
    if kind == "id":
        own = _WORDS.get(text, "word")
        return frozenset({own, "any", *(["word"] if text in _ALSO_NAMES else []), *(["for"] if text == "for" else [])})
    return frozenset({text if kind == "op" else kind, "any"})


@lru_cache(maxsize=100_000)
def _function(language: str, classes: tuple[frozenset[str], ...]) -> tuple[int, int, int, int] | None:
    """(place of the name, of the parameters, of the body, repairs) in a statement; -1 for a name or a body that it hasn't."""
    begins = any("fn" in c or "func" in c for c in classes)
    if not begins and not any("Round" in a and ("Curly" in b or ":" in b or "throws" in b or "=>" in b) for a, b in zip(classes, classes[1:])) and not any("=>" in c for c in classes):
        return None
    parse = _parser.parse(list(classes), language, budget=REPAIRS if begins else 0)
    root = parse.derive(language, 0, len(classes)) if parse else None
    if root is None:
        return None
    places: dict[str, int] = {}

    def walk(node: list) -> None:
        for child in node[3]:
            if isinstance(child, list):
                if child[0] in ("Name", "Params", "Body"):
                    if child[2] > child[1]:  # else supplied by a repair
                        places.setdefault(child[0], child[1])
                elif child[0] not in ("Type", "Wide", "Kind", "Rest", "Attributes", "Generic"):
                    walk(child)

    walk(root)
    return places.get("Name", -1), places.get("Params", -1), places.get("Body", -1), parse.cost


_ASI_ENDS, _ASI_STARTS = frozenset(["id", "num", "str", "Round", "Square", "Curly"]), frozenset(["id", "str"])
_STARTERS = frozenset(w for w, k in _WORDS.items() if k in ("fn", "func", "declare")) | frozenset("pub public private protected export static class import package use struct impl trait mod type interface typedef".split())


def _statements(group: Node, family: str) -> Iterator[list[Node]]:
    """The statements of a group: to an end sign, a comma between members, a brace that ends one, or a line that begins anew."""
    now: list[Node] = []
    angles = 0
    for n in group.inner:
        if not now:
            angles = 0
        angles += (n.text == "<") - (n.text == ">")
        if now and n.fresh and (n.text in _STARTERS and (now[-1].kind != "op" or family != "js") and now[-1].text not in _WORDS or family in ("js", "go") and now[-1].kind in _ASI_ENDS and n.kind in _ASI_STARTS and now[-1].text not in _WORDS):
            yield now
            now = []
        if n.kind == "op" and (n.text == ";" or n.text == "," and family == "js" and angles <= 0):
            if now:
                yield now
            now = []
            continue
        if now and now[-1].kind == "Curly" and n.kind != "Curly" and not (n.kind == "op" and n.text in ("=>", "=", ".", "|", "&", "[")):
            yield now
            now = []
        now.append(n)
    if now:
        yield now


def _lines(group: Node) -> Iterator[list[Node]]:
    """Logical lines of a Python file."""
    now: list[Node] = []
    for n in group.inner:
        if n.fresh and now:
            yield now
            now = []
        now.append(n)
    if now:
        yield now


def body_valid(language: str, text: str) -> bool:
    """Whether a body, with its braces, or dedented in Python, follows the grammar of its language."""
    shape = lex(text, language)
    pairs = permitted_pairs(language)
    plain = shape.translate(_PLAIN)
    if any(pair not in pairs for pair in zip(plain, plain[1:])):
        return False
    stack: list[tuple[str, list[str]]] = [("", [])]
    for letter in shape:
        if letter in _PLACES:
            stack[-1][1].append(_PLACES[letter])
            stack.append((letter, []))
        elif letter in ")]}":
            opener, inner = stack.pop()
            if not stack or _PLAIN_CLOSE[opener] != letter or not group_valid(language, opener, "".join(inner)):
                return False
        else:
            stack[-1][1].append(letter)
    return len(stack) == 1 and (language != "py" or group_valid(language, "", "".join(stack[0][1])))


_PLACES, _PLAIN_CLOSE = {"(": "P", "<": "P", "[": "K", "{": "Z", "%": "Z", "~": "Z"}, {"": "", "(": ")", "<": ")", "[": "]", "{": "}", "%": "}", "~": "}"}
_PLAIN = str.maketrans("<%~", "({{")


@dataclass
class Function:
    """A function with its places in the text: of its first token, its header's end, and its body."""

    name: str
    start: int
    head: int
    end: int
    params: Node | None
    body: int
    repairs: int
    complete: bool


def functions(text: str, language: str) -> Iterator[Function]:
    """The functions of a file, in the order in which they begin, inner ones after the outer."""
    family = _FAMILY.get(language, language)
    if family not in _START:
        return
    root = nest(text, family)
    found = list(_python(text, root) if family == "py" else _braced(text, root, language, family))
    yield from sorted(found, key=lambda f: (f.start, -f.end))


def _braced(text: str, root: Node, language: str, family: str) -> Iterator[Function]:
    todo = [root]
    while todo:
        group = todo.pop()
        todo += [n for n in group.inner if n.inner]
        for statement in _statements(group, family):
            at = _function(_START[family], tuple(map(_class, statement)))
            if at is None:
                continue
            name, params, body, cost = at
            named = statement[name].text if name >= 0 else ""
            if not named:
                continue
            inner = statement[body] if body >= 0 else statement[-1]
            rounds = statement[params] if params >= 0 else None
            repairs = cost + inner.repairs + (rounds.repairs if rounds else 0)
            complete = repairs == 0 and (inner.kind != "Curly" or inner.closed and body_valid(language, text[inner.start : inner.end]))
            yield Function(named, statement[0].start, inner.start if inner.kind == "Curly" else inner.end, inner.end, rounds, inner.start, repairs, complete)


def _python(text: str, root: Node) -> Iterator[Function]:
    lines = [(x, x[0].start - (text.rfind("\n", 0, x[0].start) + 1)) for x in _lines(root)]
    for k, (line, indent) in enumerate(lines):
        at = _function("Python", tuple(map(_class, line)))
        if at is None or at[0] < 0:
            continue
        name, params, _, cost = at
        first = k
        while first and lines[first - 1][0][0].text == "@" and lines[first - 1][1] == indent:
            first -= 1
        last = next((j for j in range(k + 1, len(lines)) if lines[j][1] <= indent), len(lines))
        end = lines[last - 1][0][-1].end
        colon = next((n.end for n in line[params + 1 :] if n.text == ":"), line[-1].end) if params >= 0 else line[-1].end
        repairs = cost + sum(n.repairs for x, _ in lines[k:last] for n in x)
        block = text[line[0].start - indent : end]
        complete = repairs == 0 and (last > k + 1 or colon < line[-1].end) and body_valid("py", textwrap.dedent(block) + "\n")
        yield Function(line[name].text, lines[first][0][0].start, colon, end, line[params] if params >= 0 else None, colon, repairs, complete)
