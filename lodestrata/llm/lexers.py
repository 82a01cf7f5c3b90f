"""Lexers that turn source files into token classes of :mod:`grammars`.

A lexer gives a string with one letter a token.  The class ``!`` is a lexical
error: an unfinished string or comment, a character or number that the language
doesn't have, an indentation that fits no block.  Brackets stand for themselves,
but for Go's ``<``, a parenthesis that opens parameters, and ``%``, a brace that
opens fields, and for the ``~`` of JavaScript and TypeScript, a brace that begins
a statement, so a block and no object; they close with ``)`` and ``}``.
"""

from __future__ import annotations

import re
from lodestrata.llm.grammars import LANGUAGES

_OPEN, _CLOSE = "([{", ")]}"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_NUMBER = r"0[xXbBoO][0-9a-fA-F_]+[A-Za-z]{0,4}\d{0,3}|(?:\d[\d_']*)(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+\-]?\d[\d_]*)?(?:_?[iuf](?:8|16|32|64|128|size)|[lLuUfFdDn]{1,3})?(?![\w])|\.\d+(?:[eE][+\-]?\d+)?[fFdD]?(?!\w)"
_OPERATORS = r">>>=|\.\.\.|\.\.=|<<=|>>=|===|!==|\*\*=|\?\?=|&&=|\|\|=|&\^=|>>>|->|=>|::|:=|<-|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|<<|>>|\*\*|&\^|\.\.|[^\s]"

_BASE = {
    ".": ".", ",": "m", ";": "t", ":": "o", "?": "q", "+": "d", "-": "d", "*": "c", "&": "c", "/": "b", "%": "b", "^": "b", "|": "b", "==": "b", "!=": "b", "===": "b", "!==": "b", "<=": "b", ">=": "b", "&&": "b", "||": "b", "??": "b",
    "<<": "b", ">>": "b", ">>>": "b", "&^": "b", "<": "l", ">": "r", "++": "u", "--": "u", "!": "h", "~": "h", "=": "e", "=>": "g", "->": "y", "::": "D", "...": "z", "..": "z", "..=": "z", "@": "@", "#": "x", "?.": ".",
} | {op: "E" for op in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "??=", "&&=", "||=", "&^=")}
#: What a language's operators are where they differ from the common ones; "!" where it doesn't have them.
_OWN = {
    "js": {"**": "b", "..": "!", "..=": "!", "::": "!", "->": "!", ":=": "!", "<-": "!", "@": "@", "&^": "!", "&^=": "!"},
    "java": {"**": "!", "..": "!", "===": "!", "!==": "!", "=>": "!", ":=": "!", "??": "!", "?.": "!", "#": "!", "&^": "!"},
    "c": {"**": "c", "..": "!", "===": "!", "!==": "!", "=>": "!", ":=": "!", "??": "!", "::": "!", "@": "!", "<": "b", ">": "b", "->": "y", "#": "!", "?.": "!", "$": "!"},
    "go": {"**": "c", "..": "!", "===": "!", "!==": "!", "=>": "!", ":=": "e", "<-": "y", "::": "!", "->": "!", "?": "!", "@": "!", "#": "!", "&^": "b", "&^=": "E", "<": "b", ">": "b", "??": "!", "?.": "!"},
    "rs": {"**": "c", "++": "!", "--": "!", "===": "!", "!==": "!", ":=": "!", "<-": "!", "??": "q", "?.": ".", "~": "!", ">>>": "!"},
}
_OWN["ts"] = _OWN["js"]

_TEXT = {
    "js": r"\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`",
    "java": r"\"\"\"(?:\\[\s\S]|(?!\"\"\")[\s\S])*\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\u+[0-9a-fA-F]{4}|\\.[0-7]{0,2}|[^'\\\n])'",
    "c": r"(?:u8|[LuU])?\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\"|[LuU]?'(?:\\(?:x[0-9a-fA-F]+|[0-7]{1,3}|.)|[^'\\\n])+'",
    "go": r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)|[^'\\\n])'",
    "rs": r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'",
}
_TEXT["ts"] = _TEXT["js"]
_BRACE = {k: re.compile(rf"[^\S\n﻿]*﻿?[^\S\n]*(?:(?P<nl>\n{'' if k == 'c' else chr(92) + 's*'})|(?P<note>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>{v})|(?P<life>'[A-Za-z_]\w*(?!'))|(?P<n>{_NUMBER})|(?P<i>r#\w+|{_NAME})|(?P<op>{_OPERATORS}))") for k, v in _TEXT.items()}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:include[ \t]*(?:<[^<>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*)|(?:define|undef|ifdef|ifndef)[ \t]+[A-Za-z_]\w*|if\b[^\n]+|elif\b[^\n]+|else\b|endif\b|pragma\b|error\b|warning\b|line[ \t]+\d+|(?=\r?\n|$))(?:\\\r?\n|[^\n])*")


#: Classes after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("^(,[{;mtodcbhelrEgqzNRBuVXYGH")
_SOFT = frozenset("get set static async type declare abstract readonly override namespace module enum of from as satisfies infer unique keyof is record sealed yield union default non".split())
_BREAKS, _STARTS = frozenset("insukR)]"), frozenset("insFCVRkIXMNu@WQGH")
_GO_ENDS = frozenset("insukR)]}")


def _brace(text: str, language: str) -> list[str]:
    family = "c" if language == "h" else language
    match, words = _BRACE[family].match, LANGUAGES[family].keywords
    operators = _BASE | _OWN[family] | {x: x for x in _OPEN + _CLOSE}
    script, go, c = family in ("js", "ts"), family == "go", family == "c"
    at, n = 0, len(text)
    out: list[str] = []
    put = out.append
    last, before, newline, contextual, header, depth = "^", "", False, False, -1, 0
    if text.startswith("#!") and family in ("js", "ts", "rs") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else n
    while True:
        if c and (at == 0 or text[at - 1] == "\n") and (m := _DIRECTIVE.match(text, at)):
            at = m.end()
            continue
        m = match(text, at)
        if m is None:  # blanks at the end
            break
        kind, at = m.lastgroup, m.end()
        if kind == "nl" or kind == "note":
            if kind == "nl" or "\n" in m.group("note"):
                newline = True
                if go and last in _GO_ENDS:
                    put("t")
                    last = "t"
            continue
        if kind == "i":
            word = m.group("i")
            if last == "." and word != "class":
                letter = "i"
            elif word in _SOFT:
                letter = _contextual(text, at, word, family, words, last, contextual)
            else:
                letter = words.get(word, "i")
            if script and (letter == "I" or letter == "X") and last in "^t}":
                contextual = True
        elif kind == "op":
            word = m.group("op")
            if word[0] == "/" and script and last in _BEFORE_REGEX and (r := _REGEX.match(text, m.start("op"))):
                put("n")
                last, at = "n", r.end()
                continue
            letter = operators.get(word, "!")
            if word == "/" and text.startswith("/*", at - 1):
                letter = "!"
        elif kind == "life":
            letter = "T" if family == "rs" else "!"
        else:
            letter = kind
        if newline and script and last in _BREAKS and letter in _STARTS and not ((letter == "G" or letter == "H") and word in ("else", "catch", "finally", "while")):
            put("t")
            contextual, last = False, "t"
        if go:
            if letter == "G":
                header = depth
            elif letter == "{" and header == depth:
                header = -1
            elif letter == "t" and header == depth:
                letter = "j"
            if letter in _OPEN:
                depth += 1
            elif letter in _CLOSE:
                depth -= 1
            put("%" if letter == "{" and last == "C" else "<" if letter == "(" and (last == "F" or before == "F" or last == ")") else letter)
        else:
            put("~" if letter == "{" and script and last in "^t" else letter)
        if letter == "t":
            contextual = False
        before, last, newline = last, letter, False
    if go and last in _GO_ENDS:
        put("t")
    return out


_NEXT = re.compile(r"\s*(?:([^\W\d][\w$]*)|(\S))")


def _contextual(text: str, at: int, word: str, family: str, words: dict[str, str], last: str, importing: bool) -> str:
    """The class of a word that is a keyword only in some places."""
    m = _NEXT.match(text, at)
    name, sign = (m.group(1), m.group(2)) if m else (None, None)
    if word in ("from", "as") and importing and last in "iZ}cs)Y":
        return "j"
    if family in ("js", "ts"):
        if word == "of":
            return "b" if last in "i]}" and (name or sign in ("[", "{", "(", '"', "'")) else "i"
        if word in ("get", "set", "static", "async"):
            return "M" if name and name not in ("in", "of", "instanceof") or sign in ("[", "*", "#") or word in ("async", "static") and (sign == "(" and word == "async" and "=>" in text[at : at + 200] or sign == "{") else "i"
        if family == "ts":
            if word == "type":
                return "W" if name else "i"
            if word in ("as", "satisfies", "is"):
                return "A" if last in "in)]}s" and (name or sign) and (name or sign in "({[") else "i"
            if word in ("infer", "unique", "keyof"):
                return "N" if name and last in "o(lebqgm" else "i"
            if word in ("declare", "abstract", "readonly", "override", "namespace", "module", "enum"):
                return words.get(word, "W") if name or sign == '"' and word in ("module", "namespace") else "i"
        return words.get(word, "i")
    if family == "java" and word in ("record", "sealed", "yield", "non"):
        return words.get(word, "i") if name and last in "^t{}M;@" else "i"
    if family == "rs" and word == "union":
        return "S" if name and last in "^t}V{" else "i"
    if family == "rs" and word == "default":
        return "V" if name in ("fn", "impl", "type", "const", "unsafe", "async") else "i"
    return words.get(word, "i")


_PY = re.compile(
    r"(?:[^\S\n]|\\\r?\n)*(?:(?P<note>\#[^\n]*)|(?P<nl>\n)|(?P<s>(?:[rRbBuUfF]{1,2})?(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\[\s\S]|(?!''')[^\\])*'''|\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'))"
    r"|(?P<n>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d+)?[jJ]?)(?![^\W\d]|(?<=\d)\w)|(?P<i>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[^\s]))"
)
_PY_BLANK, _PY_BAD_NUMBER = re.compile(r"[ \t\f]*"), re.compile(r"0\d*[1-9]\d*$|0\d+$")
_PY_OPS = {x: x for x in _OPEN + _CLOSE} | {".": ".", ",": "m", ";": "t", ":": "o", "+": "d", "-": "d", "*": "c", "**": "c", "&": "b", "/": "b", "//": "b", "%": "b", "^": "b", "|": "b", "==": "b", "!=": "b", "<=": "b", ">=": "b", "<": "b", ">": "b", "<<": "b", ">>": "b", "~": "h", "=": "e", "->": "y", "...": "z", "@": "@"} | {op: "E" for op in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "//=", "@=", ":=")}


def _python(text: str, language: str) -> list[str]:
    words = LANGUAGES["py"].keywords
    at, depth, last = 0, 0, "^"
    stack, opened, fresh = [(0, 0)], False, True
    out: list[str] = []
    put = out.append
    if text.startswith("﻿"):
        at = 1
    while True:
        if fresh and depth == 0:
            m = _PY_BLANK.match(text, at)
            rest = text[m.end() : m.end() + 2]
            if rest[:1] not in ("", "\n", "#", "\r") or rest[:1] == "\r" and rest[1:] != "\n" and rest != "\r":
                blank = m.group()
                now = (len(blank.expandtabs(8)), len(blank))
                top = stack[-1]
                if now[0] > top[0] and now[1] > top[1]:
                    if not opened:
                        put("!")
                    stack.append(now)
                elif now != top and (now[0] >= top[0] or now[1] >= top[1]):
                    put("!")
                else:
                    if opened:
                        put("!")
                    while len(stack) > 1 and stack[-1][0] > now[0]:
                        stack.pop()
                    if stack[-1] != now:
                        put("!")
                        stack[-1] = now
                opened, fresh = False, False
        m = _PY.match(text, at)
        if m is None:  # blanks at the end
            break
        kind, at = m.lastgroup, m.end()
        if kind == "note":
            continue
        if kind == "nl":
            if depth == 0:
                if last != "^" and last != "t":
                    opened = last == "o"
                    put("t")
                    last = "t"
                fresh = True
            continue
        if kind == "i":
            letter = words.get(m.group("i"), "i")
        elif kind == "op":
            letter = _PY_OPS.get(m.group("op"), "!")
            if letter in _OPEN:
                depth += 1
            elif letter in _CLOSE and depth:
                depth -= 1
        elif kind == "n":
            word = m.group("n")
            letter = "!" if _PY_BAD_NUMBER.match(word) and word.strip("0") else "n"
        else:
            letter = kind
        put(letter)
        last = letter
    if last not in "^t" and depth == 0:
        opened = last == "o"
        put("t")
    if opened:
        put("!")
    return out


_TOML = re.compile(
    r"(?P<skip>[^\S\n]+)|(?P<note>\#[^\n]*)|(?P<nl>\n)|(?P<s>\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"\"{0,2}|'''(?:(?!''')[\s\S])*'''|\"(?:\\(?:[btnfre\"\\]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|[^\"\\\n\x00-\x08\x0e-\x1f])*\"|'[^'\n]*')"
    r"|(?P<v>(?:[+\-]?(?:inf|nan)|true|false|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+\-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[+\-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+\-]?\d+)?)(?![\w\-.:+]))|(?P<i>[A-Za-z0-9_\-]+)|(?P<op>[^\s])"
)
_JSON = re.compile(r"(?P<skip>[ \t\r\n]+|﻿)|(?P<s>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+\-]?\d+)?(?![\w.])|true\b|false\b|null\b)|(?P<op>[\s\S])")


def _toml(text: str, language: str) -> list[str]:
    depth, last, value = 0, "^", False
    modes: list[bool] = []
    tables: list[bool] = []
    out: list[str] = []
    for m in _TOML.finditer(text.replace("\r\n", "\n")):
        kind, word = m.lastgroup, m.group()
        if kind in ("skip", "note"):
            continue
        if kind == "nl":
            if depth == 0:
                if last not in "^t":
                    out.append("t")
                last, value = "t", False
            continue
        if kind == "op":
            letter = {".": ".", ",": "m", "=": "e"}.get(word, word if word in "[]{}" else "!")
        else:
            letter = kind
        if letter == "i" and value:
            letter = "!"
        bracket = 1 if letter in "[{" else -1 if letter in "]}" else 0
        if bracket == 1:
            modes.append(value)
            value = value and letter == "["  # in an inline table a key comes first
            tables.append(letter == "{")
        elif bracket == -1:
            value = modes.pop() if modes else False
            if tables:
                tables.pop()
        elif letter == "e":
            value = True
        elif letter == "m" and tables and tables[-1]:
            value = False
        depth = max(0, depth + bracket)
        out.append(letter)
        last = letter
    if last not in "^t":
        out.append("t")
    return out


_JSON_SIGNS = {",": "m", ":": "o"} | {x: x for x in "[]{}"}


def _json(text: str, language: str) -> list[str]:
    out = []
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind != "skip":
            out.append(_JSON_SIGNS.get(m.group(), "!") if kind == "op" else kind)
    return out


_BY_LANGUAGE = {"py": _python, "toml": _toml, "json": _json}


def lex(text: str, language: str) -> str:
    """The token classes of a file, one letter each."""
    return "".join(_BY_LANGUAGE.get(language, _brace)(text, language))
