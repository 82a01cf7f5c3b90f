"""Evaluation passages inside training documents (problem 8).

Each shard of documents is turned into a word sequence and indexed with an
FM-index.  An index is a table with a row a shard, which holds all that a search
needs, so it can be stored and searched again for other items without reading a
document.  It is searched backwards for every phrase of ``min_words`` consecutive
words of every evaluation item.  Occurrences come from sampled suffix positions
and are merged to removal spans per document and item.

Words are compared after Unicode compatibility folding, case folding and
removal of invisible characters, markup, escapes, punctuation and line markers.

Defined results: null or empty texts and items shorter than ``min_words``
match nothing; repeated document rows give repeated spans; documents longer
than a shard are indexed in overlapping parts, so their text is searched whole.
"""

from __future__ import annotations

import html
import pickle
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.fmindex import FMIndex
from lodestrata.session import settle, spread

SHARD_WORDS = 500_000
#: The most bytes of evaluation text that are sent to the tasks at once; more items go through in blocks.
BLOCK_BYTES = 32_000_000

_ESCAPE = regex.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"'/\\]))")
_ENTITY = regex.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_INLINE = regex.compile(r"</?(?:b|i|em|strong|span|a|code|u|mark|sub|sup|font|small|s|del|ins|tt)(?:\s[^<>]*)?>", regex.I)
_NOTE, _TAG = regex.compile(r"<!--.*?-->", regex.S), regex.compile(r"</?[A-Za-z][^<>]*>")
_EMPHASIS = regex.compile(r"\*\*|__|~~|(?<=\w)[*_](?=\W|$)|(?<=\W|^)[*_](?=\w)")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏]")
_CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}]|[\p{L}\p{M}\p{N}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}]]+", regex.V1)
_NUMBERED = regex.compile(r"^[ \t>#*/|;%\-]*(\d{1,6})(?=[\s|.:)\]]|$)", regex.M)


def _escape(m: regex.Match) -> str:
    return chr(int(m.group(1), 16)) if m.group(1) else m.group(2) if m.group(2) in "\"'/\\" else " "


#: The passes before folding: what they look for, a cheap sign of it, and what takes its place.
_PASSES: list[tuple[str, regex.Pattern, Callable[[regex.Match], str]]] = [
    ("\\", _ESCAPE, _escape),
    ("&", _ENTITY, lambda m: html.unescape(m.group())),
    ("<", _INLINE, lambda m: ""),
    ("-->", _NOTE, lambda m: " "),
    ("<", _TAG, lambda m: " "),
]


def _line_numbers(text: str) -> list[tuple[int, int]]:
    """Places of the figures that number consecutive lines; figures that merely open a line stay."""
    found = [(m.start(1), m.end(1), int(m.group(1))) for m in _NUMBERED.finditer(text)]
    if len(found) < 2:
        return []
    keep = set()
    for k, ((a, b, x), (c, d, y)) in enumerate(zip(found, found[1:])):
        if y == x + 1 and text.count("\n", b, c) <= 2:
            keep |= {k, k + 1}
    return [found[k][:2] for k in sorted(keep)]


def words(text: str) -> list[str]:
    """The words of a text in the form in which they are compared."""
    numbered = _line_numbers(text) if "\n" in text else []
    for a, b in reversed(numbered):
        text = text[:a] + " " * (b - a) + text[b:]
    for sign, pattern, put in _PASSES:
        if sign in text:
            text = pattern.sub(put, text)
    if "*" in text or "_" in text or "~" in text:
        text = _EMPHASIS.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.casefold())


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in the original text of each word of ``words(text)``."""
    chars, origin = text, list(range(len(text) + 1))

    def substitute(pattern: regex.Pattern, put: Callable[[regex.Match], str]) -> None:
        nonlocal chars, origin
        out, places, at = [], [], 0
        for m in pattern.finditer(chars):
            new = put(m)
            out += [chars[at : m.start()], new]
            places += origin[at : m.start()] + [origin[m.start()]] * len(new)
            at = m.end()
        out.append(chars[at:])
        chars, origin = "".join(out), places + origin[at:]

    for a, b in _line_numbers(text):
        chars = chars[:a] + " " * (b - a) + chars[b:]
    for _, pattern, put in _PASSES:
        substitute(pattern, put)
    substitute(_EMPHASIS, lambda m: "")
    substitute(_INVISIBLE, lambda m: "")
    substitute(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m.group()).casefold())
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(chars)]


def _place(text: str, count: int) -> int:
    """The least number of characters at the front of a text that hold so many words."""
    low, high = 0, len(text)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(words(text[:middle])) >= count else (middle + 1, high)
    return low


class _Phrases:
    """The distinct phrases of the items and which items hold each."""

    def __init__(self, items: list[tuple[int, str]], size: int) -> None:
        vocabulary: dict[str, int] = {}
        rows, owners = [], []
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text or "")]
            for k in range(len(ids) - size + 1):
                rows.append(ids[k : k + size])
                owners.append(item)
        self.vocabulary, self.size = vocabulary, size
        grams = np.array(rows, dtype=np.int64).reshape(-1, size)
        self.grams, which = np.unique(grams, axis=0, return_inverse=True)
        by = np.argsort(which.reshape(-1), kind="stable")
        self.owners = np.array(owners, dtype=np.int64)[by]
        self.bounds = np.searchsorted(which.reshape(-1)[by], np.arange(len(self.grams) + 1))


class Shard:
    """Documents with their words and the index over them; ``parts`` are (document, offset of its first word, number of words)."""

    def __init__(self, keys: list[int], texts: list[str], parts: list[tuple[int, int, np.ndarray]], vocabulary: dict[str, int]) -> None:
        self.keys, self.vocabulary = keys, vocabulary
        self.texts = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts]
        self.parts = np.array([(d, at, len(ids)) for d, at, ids in parts], dtype=np.int64).reshape(-1, 3)
        self.begins = np.concatenate(([0], np.cumsum(self.parts[:, 2] + 1)))
        sigma = len(vocabulary) + 2
        symbols = np.full(self.begins[-1], sigma - 1, dtype=np.int64)  # the last symbol closes each part
        for (_, _, ids), b in zip(parts, self.begins):
            symbols[b : b + len(ids)] = ids
        self.index = FMIndex(symbols, sigma)

    def text(self, document: int) -> str:
        return zlib.decompress(self.texts[document]).decode("utf-8", "surrogatepass")

    def search(self, phrases: _Phrases) -> np.ndarray:
        """Rows (part, first word in it, item)."""
        # of the phrases only those whose words all occur in the shard can match
        known = np.full(len(phrases.vocabulary), -1, dtype=np.int64)
        for w, k in phrases.vocabulary.items():
            known[k] = self.vocabulary.get(w, -1)
        patterns = known[phrases.grams]
        rows = np.flatnonzero((patterns >= 0).all(axis=1))
        none = np.empty((0, 3), dtype=np.int64)
        if not len(rows):
            return none
        low, high = self.index.search(patterns[rows])
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        if not len(hit):
            return none
        every = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = self.index.locate(every)
        phrase = np.repeat(rows[hit], counts)
        held = phrases.bounds[phrase + 1] - phrases.bounds[phrase]
        owner = phrases.owners[np.repeat(phrases.bounds[phrase], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)]
        places = np.repeat(places, held)
        part = np.searchsorted(self.begins, places, side="right") - 1
        return np.stack((part, places - self.begins[part], owner), axis=1)


def _spans(parts: np.ndarray, hits: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, end word), overlapping phrases merged."""
    if not len(hits):
        return
    doc, start = parts[hits[:, 0], 0], parts[hits[:, 0], 1] + hits[:, 1]
    by = np.lexsort((start, hits[:, 2], doc))
    previous: list[int] | None = None
    for d, i, s in zip(doc[by].tolist(), hits[by, 2].tolist(), start[by].tolist()):
        if previous and previous[0] == d and previous[1] == i and s <= previous[3]:
            previous[3] = max(previous[3], s + size)
        else:
            if previous:
                yield tuple(previous)
            previous = [d, i, s, s + size]
    yield tuple(previous)


def index_shards(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12) -> DataFrame:
    """Rows (payload): one index a shard of about ``SHARD_WORDS`` words; a narrow pass, to be stored or searched at once."""
    source = spread(documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("length(_text) > 0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[int] = []
        texts: list[str] = []
        parts: list[tuple[int, int, np.ndarray]] = []
        vocabulary: dict[str, int] = {}
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal keys, texts, parts, vocabulary, held
            shard = pickle.dumps(Shard(keys, texts, parts, vocabulary), protocol=5)
            keys, texts, parts, vocabulary, held = [], [], [], {}, 0
            return pd.DataFrame({"payload": [shard]})

        for batch in batches:
            for key, text in zip(batch["_id"], batch["_text"]):
                found = words(text)
                for at in range(0, len(found), SHARD_WORDS):
                    piece = found[at : at + SHARD_WORDS + min_words - 1]
                    if len(piece) < min_words:
                        continue
                    if held and held + len(piece) > SHARD_WORDS:
                        yield flush()
                    if at == 0 or not held:  # a further part of a text that this shard doesn't hold yet
                        keys.append(key)
                        texts.append(text)
                    parts.append((len(texts) - 1, at, np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in piece), dtype=np.int64, count=len(piece))))
                    held += len(piece)
        if parts:
            yield flush()

    return source.mapInPandas(run, "payload binary")


def search_shards(index: DataFrame, items: DataFrame, min_words: int = 12, id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ``item_col``, ``n_words``, ``start_char``, ``end_char``) of the items' phrases in an index that was built for as few words.

    The items are held-out test material; they are sent in blocks of at most
    ``BLOCK_BYTES``.  With more than one block the index is settled first, so it
    is built once.
    """
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for row in items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).alias("t")).where("length(t) > 0").distinct().toLocalIterator():
        if held + len(row.t) > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((row.i, row.t))
        held += len(row.t)
    if len(blocks) > 1:
        index = settle(index)
    out = None
    for block in blocks:
        one = index.mapInPandas(_searcher(index.sparkSession.sparkContext.broadcast(block), min_words), "_id bigint, item_id bigint, n_words int, start_char int, end_char int")
        out = one if out is None else out.unionAll(one)
    return out.withColumnsRenamed({"_id": id_col, "item_id": item_col})


def _searcher(block: Broadcast, size: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = _Phrases(block.value, size)
        for batch in batches:
            for payload in batch["payload"]:
                shard = pickle.loads(payload)
                rows, places = [], {}
                for d, i, a, b in _spans(shard.parts, shard.search(phrases), size):
                    if d not in places:
                        places[d] = (text := shard.text(d)), word_places(text), len(words(text))
                    text, p, n = places[d]
                    # where letters compose otherwise in the whole text than one by one, places are found by counting words
                    start, end = (p[a][0], p[b - 1][1]) if len(p) == n else (max(0, _place(text, a + 1) - 1), _place(text, b + 1) - 1 if b < n else len(text))
                    rows.append((shard.keys[d], i, b - a, start, end))
                yield pd.DataFrame(rows, columns=["_id", "item_id", "n_words", "start_char", "end_char"]).astype({"_id": "int64", "item_id": "int64", "n_words": "int32", "start_char": "int32", "end_char": "int32"})

    return run


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ``item_col``, ``n_words``, ``start_char``, ``end_char``): one per removal span; index and search in one pass without a shuffle."""
    return search_shards(index_shards(documents, id_col, text_col, min_words), items, min_words, id_col, item_col, item_text_col)
