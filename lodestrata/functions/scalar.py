"""Column functions: identifiers, tokens, vectors, scores, paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path endings and folders that mark tests.
TEST_FOLDERS = ["/tests/", "\\tests\\", "/test/", "\\test\\"]
TEST_ENDINGS = ["_test.rs", "_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_spec.rb"]
# Names at which programs begin.
ENTRY_POINTS = ["main", "_main", "_start"]
# Names that languages ask for.
CONVENTIONAL_NAMES = (
    "new default build create init main run fmt clone clone_from eq ne hash cmp partial_cmp lt le gt ge drop deref deref_mut as_ref as_mut as_str as_bytes from into try_from try_into"
    " borrow borrow_mut to_owned to_string is_empty len iter iter_mut into_iter next serialize deserialize parse"
).split()
# Weights of the fields of a document in sparse retrieval.
FIELD_WEIGHTS = {"name": 3.0, "doc": 2.0, "sig": 1.5, "body": 0.5}
# What a source of each resolution counts.
AUTHORITY = {"section": 1.5, "symbol-full": 1.3, "symbol-stub": 1.15, "claim": 0.9, "summary": 0.85}
#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slugify(text: Column) -> Column:
    """Lower-case letters and figures; every other run is one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def section_id(path: Column, headings: Column) -> Column:
    """``path#slug/slug``; without headings ``path#root``."""
    slugs = F.array_join(F.transform(headings, slugify), "/")
    return F.concat(path, F.lit("#"), F.when(F.size(headings) > 0, slugs).otherwise("root"))


def parent_of_claim(claim: Column) -> Column:
    """The section of a claim id; the suffix after the last ``:c`` must be figures."""
    return F.when(claim.rlike(r"^(?s).*:c\d+$"), F.regexp_replace(claim, r":c\d+$", ""))


def word_count(text: Column) -> Column:
    """Words between blanks."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def analyze(text: Column) -> Column:
    """Terms of a text: each name in lower case and its camel and snake parts; terms of one byte are dropped."""
    names = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    parts = lambda w: F.filter(F.split(F.regexp_replace(w, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2"), "_"), lambda p: p != "")
    both = lambda w: F.concat(F.array(F.lower(w)), F.transform(parts(w), lambda p: F.lower(p)))
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.element_at(a, F.when(i > 0, i).otherwise(1))))
    return F.filter(F.flatten(F.transform(names, lambda w: once(both(w)))), lambda t: F.octet_length(t) > 1)


def name_tokens(query: Column) -> Column:
    """Tokens of a symbol query: split at blanks, underscores and every capital, lower case, sorted, distinct, two characters or more."""
    spread = F.regexp_replace(F.regexp_replace(query, r"\s+", "_"), r"(\p{Lu})", "_$1")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(spread, "_"), lambda t: F.lower(t)), lambda t: F.length(t) >= 2)))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for folder in TEST_FOLDERS:
        out = out | low.contains(folder)
    for ending in TEST_ENDINGS:
        out = out | low.endswith(ending)
    return out


# Languages that share their symbols, by file endings; any other ending is its own family.
FAMILIES = {"js_ts": "js jsx mjs cjs ts tsx mts cts", "c_cpp": "c h cpp cc cxx hpp hh hxx"}


def language_family(path: Column) -> Column:
    """The family of a path's language; null without an ending."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    family = F.create_map(*[F.lit(x) for k, ends in FAMILIES.items() for e in ends.split() for x in (e, k)])[end]
    return F.when(end != "", F.coalesce(family, end))


def is_placeholder(text: Column) -> Column:
    return text.startswith("[") & (text.contains("not found:") | text.contains("unavailable:"))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([\p{Ll}])(\p{Lu})", "$1_$2"))


def snake_to_camel(name: Column) -> Column:
    """Each letter after an underscore is upper case, the underscores go."""
    parts = F.split(name, "_")
    return F.concat_ws("", F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))))


def binding_key(key: Column) -> Column:
    """A key with an underscore stays; another becomes snake case."""
    return F.when(key.contains("_"), key).otherwise(camel_to_snake(key))


def http_route(method: Column, path: Column) -> Column:
    trimmed = F.lower(F.trim(path))
    short = F.when(F.length(trimmed) > 1, F.regexp_replace(trimmed, "/+$", "")).otherwise(trimmed)
    return F.concat(F.upper(method), F.lit(" "), F.when(short == "", "/").otherwise(short))


def normalize_url(url: Column) -> Column:
    """http and https only; without fragment; a closing slash where the last part has no dot."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    last = F.regexp_extract(bare, r"^https?://[^/]*((?:/[^/]*)*)$", 1)
    needs = ~bare.endswith("/") & ~F.regexp_extract(last, r"([^/]*)$", 1).contains(".")
    return F.when(bare.rlike(r"^https?://[^/]"), F.when(needs, F.concat(bare, F.lit("/"))).otherwise(bare))


def arity(signature: Column) -> Column:
    """Parameters in the first parenthesised group, counted by its commas outside inner parentheses, at most five."""
    inner = F.regexp_extract(signature, r"\(([^()]*(?:\((?:[^()]|\([^()]*\))*\)[^()]*)*)", 1)
    flat = F.regexp_replace(inner, r"\((?:[^()]|\([^()]*\))*\)", "P")
    commas = F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit("")))
    return F.when(F.coalesce(F.regexp_replace(flat, r"[ \t\n]", ""), F.lit("")) == "", 0).otherwise(F.least(commas + 1, F.lit(5)))


def risk(symbols: Column, files: Column, tests: Column) -> Column:
    score = symbols + 2 * files + 3 * tests
    return F.when((score > 50) | (files > 10), "high").when((score > 15) | (files > 3), "medium").otherwise("low")


# --- texts by role ------------------------------------------------------------------

# With what a line of source begins.
SOURCE_PREFIXES = ["///", "//!", "//", "#", "/*", "* ", "pub ", "fn ", "def ", "class ", "func ", "function ", "struct ", "impl ", "public ", "private ", "type ", "@", "package ", "import ", "use ", "template"]


def roles(text: Column) -> Column:
    """A struct (doc, sig, body): the lines before the first one that looks like source, that one, and the rest."""
    lines = F.split(text, r"\r?\n")
    first = F.array_position(F.transform(lines, lambda x: F.exists(F.array(*[F.lit(p) for p in SOURCE_PREFIXES]), lambda p: F.startswith(F.regexp_replace(x, r"^\s+", ""), p))), F.lit(True))
    none = first == 0
    doc = F.when(none, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")))
    sig = F.when(none, "").otherwise(F.element_at(lines, F.greatest(first, F.lit(1)).cast("int")))
    body = F.when(none, F.array().cast("array<string>")).otherwise(F.slice(lines, (first + 1).cast("int"), F.size(lines)))
    return F.struct(F.array_join(doc, " ").alias("doc"), sig.alias("sig"), F.array_join(body, " ").alias("body"))


def name_from_id(vector_id: Column) -> Column:
    """The anchor after the last ``#``, else the last ``::`` part; inner ``::`` are blanks."""
    anchor = F.when(vector_id.contains("#"), F.substring_index(vector_id, "#", -1)).otherwise(F.substring_index(vector_id, "::", -1))
    return F.replace(anchor, F.lit("::"), F.lit(" "))


# Kinds of syntax nodes, and what stands in names of kinds that aren't listed.
NODE_KINDS = {
    "function": "function_item function_definition function_declaration method_declaration method_definition arrow_function generator_function_declaration func_literal",
    "struct": "struct_item struct_specifier union_specifier class_definition class_declaration class_specifier decorated_definition", "enum": "enum_item enum_specifier enum_declaration",
    "trait": "trait_item interface_declaration interface_definition abstract_type_declaration", "impl": "impl_item", "module": "mod_item module_declaration package_declaration module",
    "type": "type_item type_alias_declaration type_declaration type_spec alias_declaration", "const": "const_item const_declaration const_spec lexical_declaration", "static": "static_item",
}
NODE_PARTS = [("function", "function"), ("method", "function"), ("class", "struct"), ("interface", "trait"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("module", "module"), ("namespace", "module"), ("type_alias", "type"), ("typedef", "type")]


def item_kind(node_kind: Column) -> Column:
    """The kind of item that a syntax node is; null for none."""
    listed = F.create_map(*[F.lit(x) for kind, nodes in NODE_KINDS.items() for node in nodes.split() for x in (node, kind)])[node_kind]
    return F.coalesce(listed, *[F.when(node_kind.contains(part), kind) for part, kind in NODE_PARTS])


# --- questions ------------------------------------------------------------------------

# Words that name no symbol, and words that ask about bridges between languages.
HINT_STOP = (
    "the and for from with what how does are that this which where when before after into not its has have had been will was were being about between each all any both but can did get got may use used using method function struct fields response handler called returns returned why dropped"
).split()
BRIDGE_WORDS = ["tauri", "invoke", "ffi", "napi", "pyo3", "wasm", "ipc", "http route", "endpoint", "frontend", "backend", "rust side", "js side", "ts side"]
#: Fixed value: the least score of a first hit that is worth a follow-up.
FOLLOW_UP = 0.5


def _words_of(text: Column, least: int) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= least)


def symbol_hints(query: Column) -> Column:
    return F.filter(_words_of(query, 3), lambda w: ~F.lower(w).isin(*HINT_STOP))


def bridge_relevant(query: Column) -> Column:
    out = F.lit(False)
    for word in BRIDGE_WORDS:
        out = out | F.lower(query).contains(word)
    return out


def covered(question: Column, snippets: Column) -> Column:
    """Whether any snippet holds any word of four or more of the question; without such words, whether there is a snippet."""
    words = F.transform(_words_of(question, 4), lambda w: F.lower(w))
    return F.when(F.size(words) == 0, F.size(snippets) > 0).otherwise(F.exists(snippets, lambda s: F.exists(words, lambda w: F.lower(s).contains(w))))


def next_action(score: Column, resolution: Column, content_id: Column) -> Column:
    """A struct (action, id): the definition of a symbol, else the section of what was found; null below the least score."""
    symbol = resolution.startswith("symbol")
    target = F.when(resolution == "claim", F.coalesce(parent_of_claim(content_id), content_id)).otherwise(content_id)
    return F.when(score >= FOLLOW_UP, F.struct(F.when(symbol, "definition").otherwise("read").alias("action"), F.when(symbol, content_id).otherwise(target).alias("id")))


# --- vectors ---------------------------------------------------------------------


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2_normalise(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def truncate_vector(v: Column, d: int) -> Column:
    """The first d entries, normalised."""
    return l2_normalise(F.slice(v, 1, d))


def degenerate(v: Column) -> Column:
    """Squared norm not finite or under 1e-12."""
    q = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return v.isNull() | (F.size(v) == 0) | q.isNull() | F.isnan(q) | (q == float("inf")) | (q < 1e-12)


def similarity_score(cos: Column) -> Column:
    """1 - distance / 2 with distance 1 - cosine."""
    return 1 - (1 - cos) / 2


def rrf(weight: float | Column, rank0: Column) -> Column:
    return (F.lit(weight) if isinstance(weight, float) else weight) / (RRF_K + rank0 + 1)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0.5 for all where there is no range."""
    return F.when(high - low < 1.1920929e-07, 0.5).otherwise((value - low) / (high - low))


# --- sessions ---------------------------------------------------------------------


def retrievability(elapsed: Column, stability: Column) -> Column:
    return 1 / (1 + elapsed / (9 * F.greatest(stability, F.lit(0.1))))


def usage_level(fraction: Column) -> Column:
    return F.when(fraction >= 0.95, "critical").when(fraction >= 0.80, "elevated").otherwise("normal")


def prefetch_priority(confidence: Column, weight: Column, age: Column, hits: Column) -> Column:
    return confidence * weight * F.pow(F.lit(0.95), age) * (1 + F.log2(1 + hits))
