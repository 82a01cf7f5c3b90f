"""Source files that aren't valid in their language (problem 4).

Files are lexed once, to a string of token classes, which is opened into rows in
the JVM: pairs of neighbours, each once a file, are anti-joined with the pairs
that the language's grammar permits; runs of tokens up to a bracket go through
windows over running bracket depth, which check nesting and reduce each group to
one class; what stands in a group is checked against the grammar's statement
productions.  Python, JSON and TOML files that are flagged are read once more by
an exact parser, which can only withdraw a flag.

Defined results: a null text counts as empty; an empty file is valid where the
grammar lets it be; files with an extension without a grammar aren't judged.
"""

from __future__ import annotations

import ast
import json
import pickle
import re
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.llm.automata import Automaton
from lodestrata.llm.grammars import LANGUAGES
from lodestrata.llm.lexers import lex
from lodestrata.session import settle, spread, wide

_GROUP = {"P": "()", "K": "[]", "Z": "{}"}


_PARTS = ("statement", "paren", "bracket", "brace", "top", "fields", "params")
_known: dict[tuple[str, str], Automaton] = {}


def _automaton(language: str, part: str) -> Automaton:
    key = (language, part)
    if key not in _known:
        _known[key] = Automaton(getattr(LANGUAGES[language], part))
    return _known[key]


@lru_cache(maxsize=1)
def _pickled() -> bytes:
    """All automata; building them takes a task longer than reading them."""
    return pickle.dumps({(k, part): Automaton(getattr(own, part)) for k, own in LANGUAGES.items() for part in _PARTS if getattr(own, part) is not None})


@lru_cache(maxsize=None)
def permitted_pairs(language: str) -> set[tuple[str, str]]:
    """Token classes that the grammar lets stand next to each other."""
    own = LANGUAGES[language]
    statement = _automaton(language, "statement")
    out: set[tuple[str, str]] = set()

    def add(pairs: set[tuple[str, str]]) -> None:
        out.update((_GROUP.get(a, a)[-1], _GROUP.get(b, b)[0]) for a, b in pairs)

    lists = [("(", ")", p) for p in ("paren", "params") if getattr(own, p) is not None] + [("[", "]", "bracket"), ("{", "}", "brace")] + ([("{", "}", "fields")] if own.fields else [])
    for opened, closed, part in lists:
        a = _automaton(language, part)
        add(a.pairs())
        add({(opened, f) for f in a.firsts()} | {(x, closed) for x in a.lasts()})
        out.add((opened, closed))
    add(statement.pairs())
    firsts, lasts = statement.firsts(), statement.lasts()
    add({(e, f) for e in "tZ" for f in firsts} | {(x, "$") for x in lasts | set("tZ")} | {(x, "t") for x in lasts})
    if own.blocks:
        add({("{", f) for f in firsts} | {(x, "}") for x in lasts | set("tZ")})
    if own.fields:
        fields = _automaton(language, "fields")
        add({("t", f) for f in fields.firsts()} | {("t", "}")})
    add({("^", f) for f in (own.begins or firsts | {"$"})})
    if own.begins is None:
        out.add(("^", "$"))
    return out


def _pieces(letters: str, language: str) -> Iterator[str]:
    """The statements of a group: up to an end sign, or a braced group with which the statement doesn't go on."""
    own = LANGUAGES[language]
    at = 0
    for k, c in enumerate(letters):
        if c == "t":
            yield letters[at : k + own.blocks]
            at = k + 1
        elif c == "Z" and own.blocks and k + 1 < len(letters) and (k == at or letters[k + 1] not in own.goes_on) and not (own.holds and re.fullmatch(own.holds, letters[at : k + 1])):
            yield letters[at : k + 1]
            at = k + 1
    if at < len(letters):
        yield letters[at:]


@lru_cache(maxsize=200_000)
def _statement(piece: str, language: str) -> bool:
    return _automaton(language, "statement").accepts(piece)


@lru_cache(maxsize=200_000)
def group_valid(language: str, opener: str, letters: str) -> bool:
    """Whether the reduced content of a group, or of a file where there is no opener, follows a production."""
    own = LANGUAGES[language]
    if opener in ("(", "<"):
        return _automaton(language, "paren").accepts(letters) or own.params is not None and _automaton(language, "params").accepts(letters)
    if opener == "[":
        return _automaton(language, "bracket").accepts(letters)
    if opener == "%":
        return all(_automaton(language, "fields").accepts(p) for p in _pieces(letters, language))
    if opener == "{" and _automaton(language, "brace").accepts(letters):
        return True
    if opener == "{" and not own.blocks:
        return False
    if own.top is not None:
        return _automaton(language, "top").accepts(letters)
    return all(_statement(p, language) for p in _pieces(letters, language))


def parses(language: str, text: str) -> bool | None:
    """The verdict of an exact parser, None where there is none."""
    try:
        if language == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            json.loads(text)
        elif language == "toml":
            tomllib.loads(text.replace("\r\n", "\n"))
        else:
            return None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def language_of(path: str | Column) -> Column:
    column = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(column, r"\.([A-Za-z0-9]+)$", 1))


#: Brackets as the lexers write them: what they look like in a file, and the class of their group.
_SIGNS, _LOOKS, _PLACES = "([{<%~", "([{({{", "PKZPZZ"
_CLOSERS = ")]})}}"
_RUN = r"[^()\[\]{}<%~]*[()\[\]{}<%~]|[^()\[\]{}<%~]+$"


def shapes(files: DataFrame) -> DataFrame:
    """Rows (file_id, language, shape) of all files with a grammar; the shape has one letter a token."""
    source = spread(files.select("file_id", language_of("path").alias("language"), F.coalesce("content", F.lit("")).alias("content")).where(F.col("language").isin(*LANGUAGES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lex(text, k) for k, text in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("file_id").cast(pa.int64()), batch.column("language"), pa.array(found, type=pa.string())], names=["file_id", "language", "shape"])

    return source.mapInArrow(run, "file_id bigint, language string, shape string")


def odd_pairs(found: DataFrame) -> DataFrame:
    """file_id of the files in which a pair of neighbours stands that the grammar doesn't permit."""
    rows = [(k, a + b) for k in LANGUAGES for a, b in sorted(permitted_pairs(k))]
    permitted = found.sparkSession.createDataFrame(rows, "language string, pair string")  # of a fixed size: the grammars'
    plain = F.concat(F.lit("^"), F.translate("shape", _SIGNS, _LOOKS), F.lit("$"))
    pairs = found.select("file_id", "language", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?=(..))"), 1))).alias("pair"))
    return pairs.join(F.broadcast(permitted), ["language", "pair"], "left_anti").select("file_id")


def groups(found: DataFrame) -> DataFrame:
    """Rows (file_id, language, level, grp, opener, closer, letters): each bracketed group, and the file around them at level 0, with inner groups reduced to one class."""
    # a run of tokens up to and with a bracket; the windows see one row a bracket, not one a token
    runs = wide(found, "file_id").select("file_id", "language", F.posexplode(F.regexp_extract_all("shape", F.lit(_RUN), 0)).alias("pos", "run"))
    last = F.substring("run", -1, 1)
    sign = F.when(last.isin(*_SIGNS, *")]}"), last).otherwise("")
    runs = runs.withColumn("sign", sign).withColumn("step", F.when(F.col("sign").isin(*_SIGNS), 1).when(F.col("sign") != "", -1).otherwise(0))
    body = F.expr("substring(run, 1, length(run) - length(sign))")
    deep = runs.select("file_id", "language", "pos", "sign", "step", body.alias("body"), (F.sum("step").over(Window.partitionBy("file_id").orderBy("pos")) - F.col("step")).alias("level"))
    opens = F.col("step") == 1
    here = F.struct("level", F.lit(0).alias("begins"), F.lit("").alias("opener"), F.when(F.col("step") == -1, F.col("sign")).otherwise("").alias("closer"), F.when(opens, F.concat("body", F.translate("sign", _SIGNS, _PLACES))).otherwise(F.col("body")).alias("part"))
    inner = F.struct((F.col("level") + 1).alias("level"), F.lit(1).alias("begins"), F.col("sign").alias("opener"), F.lit("").alias("closer"), F.lit("").alias("part"))
    both = deep.select("file_id", "language", "pos", F.explode(F.when(opens, F.array(here, inner)).otherwise(F.array(here))).alias("e")).select("file_id", "language", "pos", "e.*")
    inside = Window.partitionBy("file_id", "level").orderBy("pos", "begins")
    numbered = both.withColumn("grp", F.sum("begins").over(inside))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "begins", "part"))), lambda x: x["part"])
    return numbered.groupBy("file_id", "language", "level", "grp").agg(F.max("opener").alias("opener"), F.max("closer").alias("closer"), F.array_join(parts, "").alias("letters"))


def flagged(files: DataFrame) -> DataFrame:
    """file_id of the files whose tokens don't follow the grammar of their language."""
    found = settle(shapes(files))  # lexed once, read for the pairs and for the groups
    machines = files.sparkSession.sparkContext.broadcast(_pickled())  # of a fixed size: the grammars'

    @F.pandas_udf(T.BooleanType())
    def valid(language: pd.Series, opener: pd.Series, letters: pd.Series) -> pd.Series:
        if not _known:
            _known.update(pickle.loads(machines.value))
        return pd.Series([group_valid(k, c, x) for k, c, x in zip(language, opener, letters)], dtype=bool)

    each = groups(found)
    closed = F.when(F.col("level") == 0, F.col("closer") == "").otherwise((F.col("level") > 0) & (F.col("closer") != "") & (F.translate("opener", _SIGNS, _CLOSERS) == F.col("closer")))
    broken = each.where(~closed | ~valid("language", "opener", "letters")).select("file_id")
    # a file without any token has no group; whether it may be empty is for the grammar to say
    empty = found.where("shape = ''").where(~valid("language", F.lit(""), "shape")).select("file_id")
    return odd_pairs(found).unionAll(broken).unionAll(empty).distinct()


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, path, root_id, language) of the files that aren't valid.

    The exact parsers see the flagged files only: their ids are settled before the contents are joined.
    """
    bad = settle(flagged(files))

    @F.pandas_udf(T.BooleanType())
    def stands(language: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([parses(k, x or "") is not True for k, x in zip(language, content)], dtype=bool)

    found = files.select("file_id", "path", "root_id", language_of("path").alias("language"), "content").join(bad, "file_id")
    exact = F.col("language").isin("py", "json", "toml")
    return found.where(~exact | stands("language", F.when(exact, F.col("content")))).select("file_id", "path", "root_id", "language")


def invalid_rates(files: DataFrame) -> DataFrame:
    """(root_id, language, n_files, n_invalid, rate) of all judged files."""
    judged = files.select("file_id", "root_id", language_of("path").alias("language")).where(F.col("language").isin(*LANGUAGES))
    bad = invalid_files(files).select("file_id", F.lit(1).alias("bad"))
    counts = judged.join(bad, "file_id", "left").groupBy("root_id", "language").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_invalid"))
    return counts.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
