"""Sentence units for documents in any language and script (problem 9).

Boundaries follow the sentence rules of Unicode Standard Annex 29, with the
character classes read from the ``regex`` module's property tables, so every
script's own terminator works:

* SB3, SB4: blank lines, headings and list items separate; a single line break is a blank.
* SB5: format characters and marks are passed over where words are looked up.
* SB6: no break between a full stop and a figure; SB7: nor in ``U.S``, nor in dotted names.
* SB8: a lower-case start doesn't suppress a break after a full stop, unless the word before
  may be an abbreviation; the data begin sentences in lower case, so this rule is tailored.
* SB8a: no break before what continues a sentence (``SContinue``, another terminator).
* SB9 to SB11: closing quotes and brackets and blanks belong to the sentence before; then it breaks.

Tailorings for languages suppress breaks after their abbreviations, for quotations
keep what is inside one in its sentence, for Greek take ``;`` as a terminator, and
for Thai, Lao and Khmer take blanks as separators.

Defined results: a null, empty or blank text has no units; repeated rows give
repeated units; a text of any length is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

# Abbreviations that never close a sentence, by language.
NEVER_FINAL = {
    "en": "mr mrs ms dr prof rev gen col sgt lt capt gov hon messrs st mt fig figs eq eqs ch chap vol vols pp cf viz approx vs est dept e.g i.e ca al ed eds resp incl",
    "de": "hr fr dr prof dipl ing nr bzw ca vgl abb abs bd evtl ggf inkl max min sog str tel z.b d.h u.a i.d.r s.o s.u z.t",
    "fr": "m mm mme mmes mlle mlles dr pr env fig p.ex c.-à-d vol art chap éd réf tél",
    "es": "sr sra sres sras srta dr dra d dña prof núm aprox fig pág págs vol art cap p.ej ee ud uds tel",
    "ru": "ок рис стр см гл табл напр т.е ул г-н г-жа проф акад им",
    "el": "κ κα κος π.χ δηλ σελ αρ βλ κεφ",
    "ar": "د أ ص ج",
    "hi": "डॉ श्री प्रो",
    "it": "sig sigg dott dott.ssa ing avv pag fig vol",
    "pt": "sr sra dr dra prof pág fig vol núm",
}
# Abbreviations that may close a sentence; they do unless a plain lower-case word follows.
MAYBE_FINAL = "etc usw u.s.w a.m p.m т.д т.п др пр κ.λπ κλπ κ.ά jr sr inc ltd co corp bros ff seq evtl".split()
# Abbreviations only in front of a figure.
BEFORE_FIGURE = "no nos sec secs p max min nr n fig art ver v".split()
# Month names after an ordinal dot.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember".split()

_NEVER = {w for words in NEVER_FINAL.values() for w in words.split()} - {"sr"}
_MAYBE, _FIGURE, _MONTH = set(MAYBE_FINAL) - {"sr"}, set(BEFORE_FIGURE), set(MONTHS)

_PAIR = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "‘": "’", "(": ")", "[": "]", "（": "）", "【": "】", "〈": "〉", "《": "》", "»": "«"}
_CLOSERS = {c for v in _PAIR.values() for c in v} - {"«"}
_QUOTES = set('"“”„«»‹›「」『』‘’')

_TOKEN = regex.compile(
    r"(?P<code>`[^`\n]+`)|(?P<url>\b[a-z][a-z0-9+]+://(?:(?![.!?]+(?:\p{Lu}|[`(¿¡«“\"]))[^\s<>\"'「」。！？，、）)])+)"
    r"|(?P<quote>[\"“”„«»‹›「」『』()\[\]（）【】〈〉《》])"
    r"|(?P<term>[\p{SB=STerm}\p{SB=ATerm}…‥;;](?:[  ]?[\p{SB=STerm}\p{SB=ATerm}…‥])*)"
)
_STERM = regex.compile(r"[\p{SB=STerm}]")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}](?:[\p{L}\p{M}\p{Cf}]|[.\-]{1,2}(?=[\p{L}\p{M}]))*\Z")
_ABBR_PAIR = regex.compile(r"(?:^|[^\p{L}])(\p{L}\.\s?\p{L}{1,4})\Z")
_CODE_LIKE = regex.compile(r"(?:`|[^\s`]*[_/]|\p{Ll}+-\p{L}|\p{Ll}+\d|\p{Ll}+\p{Lu})")
_LAST_TOKEN = regex.compile(r"\S+\Z")
_GREEK, _THAI = regex.compile(r"\p{Greek}"), regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}]")
_LETTER = regex.compile(r"\p{L}")
_BLANK, _FORMAT, _FIRST_WORD = regex.compile(r"\s"), regex.compile(r"\p{Cf}"), regex.compile(r"\p{L}*")
_DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}")
_LETTER_OR_FIGURE, _FIGURE_END = regex.compile(r"[\p{L}\d]"), regex.compile(r"\d\.\d+%?\Z")
_NEW_SENTENCE = regex.compile(r"\p{Lu}[\p{L}\p{M}]*(?:['’]\p{L}+)?(?:[ ,.\n…:]|\Z)|\p{Lu}\p{Ll}+\p{Lu}")
_WORD_END = regex.compile(r"\p{L}[\p{L}\p{M}]\Z|\d\Z")
_HAN, _BOUND_HYPHEN, _CHUNK = regex.compile(r"\p{Han}"), regex.compile(r"-\S"), regex.compile(r"\S+")
_HEADING = regex.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
_ITEM = regex.compile(r"[ \t]*(?:[-*+•‣◦]|\d{1,9}[.)])(?:[ \t]+|$)")
_CONTINUES = regex.compile(r"\p{SB=SContinue}")


def _matched(par: str) -> dict[int, int]:
    """Opening position -> closing position of the quotes and brackets that close within the paragraph."""
    pairs: dict[int, int] = {}
    stack: list[tuple[int, str]] = []
    plain: int | None = None
    for m in _TOKEN.finditer(par):
        if m.lastgroup != "quote":
            continue
        i, ch = m.start(), m.group()
        if ch == '"':
            if plain is None:
                plain = i
            else:
                pairs[plain], plain = i, None
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][1]), None)
        if at is not None:
            pairs[stack[at][0]] = i
            del stack[at:]
        elif ch in _PAIR:
            stack.append((i, _PAIR[ch]))
    return pairs


def _final_dot(par: str, start: int, nxt: int) -> bool:
    """Whether a lone full stop at ``start`` ends a sentence, given that a blank follows; ``nxt`` is the next character's place."""
    head, c = par[max(0, start - 40) : start], par[nxt]  # no abbreviation is longer, and a chain of initials ends as it goes on
    plain_lower = c.islower() and not _CODE_LIKE.match(par, nxt)
    m = _WORD_BEFORE.search(head)
    if m is None:
        if head[-1:].isdigit():  # an ordinal in front of a month
            number = _LAST_TOKEN.search(head).group()
            return not (len(number) <= 2 and number.isdigit() and _FIRST_WORD.match(par, nxt).group().lower() in _MONTH)
        return True
    word = (m.group() if m.group().isascii() else _FORMAT.sub("", m.group())).lower()
    pair = _ABBR_PAIR.search(head)
    both = _BLANK.sub("", pair.group(1)).lower() if pair else ""
    if both in _NEVER:
        return False
    if both in _MAYBE:
        return not plain_lower
    if word in _MAYBE:
        return not plain_lower
    if word in _NEVER:
        return False
    if word in _FIGURE and (c.isdigit() or c == "#"):
        return False
    if len(word) == 1 and not (m.start() and head[m.start() - 1].isdigit()):  # an initial, or a part such as "z." in "z. B."
        return False
    return not ("." in word and _DOTTED.fullmatch(word))  # U.S., e.g.


class _Token:
    """What is known of the run of non-blanks that a place lies in; places are asked for in ascending order."""

    def __init__(self, par: str) -> None:
        self.par, self.runs = par, _CHUNK.finditer(par)
        self.start = self.end = 0

    def at(self, place: int) -> "_Token":
        while self.end < place:
            m = next(self.runs)
            self.start, self.end = m.span()
            dot, slash = self.par.find(".", *m.span()), self.par.find("/", *m.span())
            self.dot, self.slash = dot if dot >= 0 else self.end, slash if slash >= 0 else self.end
            first = _LETTER_OR_FIGURE.search(self.par, *m.span())
            self.first = first.start() if first else self.end
        return self


def _joined_dot(par: str, start: int, nxt: int, token: _Token) -> bool:
    """Whether a full stop without a blank behind it ends a sentence."""
    c, last = par[nxt], par[start - 1 : start]
    if not last or last.isspace():
        return False
    run = token.at(start)
    if run.first == start - 1 and _LETTER.match(last):  # one letter
        return False
    if last == "." or _final_dot(par, start, nxt) is False:
        return False
    if run.dot < start and run.slash >= start and not _FIGURE_END.search(par, max(run.start, start - 40), start) and last not in "`)\"»”":
        return False  # a dotted name
    if c.isupper():
        return _NEW_SENTENCE.match(par, nxt) is not None and (_WORD_END.search(par, max(run.start, start - 40), start) is not None or last in "`%)»”\"")
    if c in "`¿¡«“„\"":
        return last.isalnum() or last in "`%)"
    if c == "(":
        return par[nxt + 1 : nxt + 2].isupper() and last.isalnum()
    if _LETTER.match(c) and not c.islower():  # scripts without case
        return last == "`" or last == "%" or (last.isalpha() and not last.isascii() and last.lower() == last.upper())
    return False


def _ends(par: str) -> Iterator[int]:
    """End offsets of the sentences inside a paragraph (blanks not yet trimmed)."""
    closing = _matched(par)
    closed_by = {v: k for k, v in closing.items()}
    greek = not par.isascii() and _GREEK.search(par) is not None and len(_GREEK.findall(par)) * 3 > len(_LETTER.findall(par))
    depth, n = 0, len(par)
    skip, token = 0, _Token(par)
    for m in _TOKEN.finditer(par):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if s < skip:
            continue
        if kind == "quote":
            depth += (s in closing) - (s in closed_by)
            continue
        if kind == "code":
            continue
        if kind == "url":  # its last dots and marks belong to the sentence
            body = m.group().rstrip(".!?;…")
            s, e = s + len(body), e
            if s == e:
                continue
        marks = par[s:e]
        if marks[0] in ";;":
            if not greek and marks[0] == ";":
                continue
        end, quoted, bracketed = e, False, False
        while end < n:
            ch = par[end]
            if end in closed_by:
                depth -= 1
                quoted, bracketed = quoted or ch in _QUOTES, bracketed or ch not in _QUOTES
                end += 1
            elif ch in "  " and end + 1 in closed_by and par[end + 1] in "»":
                end += 1
            elif ch in "’'*_" and (end + 1 == n or par[end + 1].isspace()):
                end += 1
            else:
                break
        skip = max(skip, end)
        if depth > 0:
            continue
        nxt = end
        while nxt < n and par[nxt].isspace():
            nxt += 1
        if nxt == n:
            continue
        blank, c = nxt > end, par[nxt]
        strong = bool(_STERM.search(marks)) or marks[0] in ";;"
        if _CONTINUES.match(c) and not (c == "-" and _BOUND_HYPHEN.match(par[nxt : nxt + 2])):
            continue
        lower = c.islower() and not _CODE_LIKE.match(par, nxt)
        if (quoted or bracketed) and (lower or (not blank and _LETTER.match(c) and not c.isupper() and not _HAN.match(c))):
            continue
        if not strong:
            if len(marks.replace(" ", "")) > 1 or marks[0] in "…‥":
                if not (blank and c.isupper()):
                    continue
            elif not (quoted or bracketed):
                if marks in "．。":
                    if par[s - 1 : s].isdigit() and c.isdigit():
                        continue
                elif not (_final_dot(par, s, nxt) if blank else _joined_dot(par, s, nxt, token)):
                    continue
            elif not blank and c.isdigit():
                continue
        elif not blank and not (quoted or bracketed) and marks[-1].isascii() and (c.islower() or c.isdigit() or c in "=&/_#%@|"):
            continue
        yield end


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in order; end is exclusive and no unit has blanks at its ends."""
    if not text:
        return []
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def paragraph(a: int, b: int) -> None:
        par = text[a:b]
        if not par.isascii() and _THAI.search(par) and len(_THAI.findall(par)) * 5 > len(_LETTER.findall(par)):
            for m in _CHUNK.finditer(par):
                out.append((a + m.start(), a + m.end()))
            return
        at = 0
        for end in _ends(par):
            add(a + at, a + end)
            at = end
        add(a + at, b)

    pos, begun, n = 0, None, len(text)
    while pos <= n:
        stop = text.find("\n", pos)
        stop = n if stop < 0 else stop
        line = text[pos:stop]
        mark = _HEADING.match(line) or _ITEM.match(line)
        if mark or not line.strip():
            if begun is not None:
                paragraph(begun, pos)
                begun = None
            if mark:
                add(pos + mark.end(), stop)
        elif begun is None:
            begun = pos
        pos = stop + 1
    if begun is not None:
        paragraph(begun, n)
    return out


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, ``start_char``, ``end_char``) per sentence unit of ``text_col``.

    Narrow: one Arrow pass over the two columns, no shuffle.  Other columns of
    the input, whatever their names, are not read.
    """
    source = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("length(_text) > 0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, text in zip(batch["_id"], batch["_text"]):
                for a, b in units(text):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"_id": pd.Series(ids, dtype=batch["_id"].dtype), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInPandas(run, f"_id {kind}, start_char int, end_char int").withColumnRenamed("_id", id_col)
