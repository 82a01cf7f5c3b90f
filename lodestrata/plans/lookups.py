"""Queries over sections, symbols and files: lookups, listings, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.operators import lookup as L
from lodestrata.sources import code, documents, files, frameworks
from lodestrata.session import table

SYMBOLS = "(SELECT DISTINCT id, file_path, name, kind, visibility, signature, doc_comment, module_path, line_start, line_end, cyclomatic_complexity FROM symbols)"
SECTIONS = "(SELECT DISTINCT id, document_id, heading_path, depth, text, summary, position FROM sections)"

_EXT = r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in L.LANGUAGES.items()) + " ELSE 'other' END"
TEST_PATH = "(" + " OR ".join([f"contains(lower(p), '{f}')" for f in S.TEST_FOLDERS] + [f"ends_with(lower(p), '{e}')" for e in S.TEST_ENDINGS]) + ")"

QUERIES = {
    "corpus_stats": lambda s, d: L.corpus_stats(table(s, d, "documents"), table(s, d, "sections"), table(s, d, "symbols")),
    "toc": lambda s, d: L.toc(table(s, d, "sections")),
    "next_section": lambda s, d: L.next_sections(table(s, d, "sections")),
    "symbol_definitions": lambda s, d: L.definitions(table(s, d, "symbols"), table(s, d, "source_files")),
    "language_stats": lambda s, d: L.language_stats(table(s, d, "source_files")),
    "resolve_content": lambda s, d: L.resolve_content(table(s, d, "sections"), table(s, d, "symbols")),
    "test_files": lambda s, d: table(s, d, "source_files").where(S.is_test_path(F.col("path"))).select("path"),
    "documents_by_root": lambda s, d: table(s, d, "documents").groupBy("root_id").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("ingested_at").alias("newest")),
    "section_documents": lambda s, d: table(s, d, "sections").dropDuplicates(["id"]).join(table(s, d, "documents").select(F.col("source_path").alias("document_id"), "doc_id", "title"), "document_id").select("id", "doc_id", "title", "position"),
    "orphan_sections": lambda s, d: table(s, d, "sections").join(table(s, d, "documents").select(F.col("source_path").alias("document_id")), "document_id", "left_anti").select("id", "document_id").distinct(),
    "symbol_kinds": lambda s, d: table(s, d, "symbols").dropDuplicates(["id"]).groupBy(F.lower(F.trim("kind")).alias("kind")).agg(F.count("*").alias("symbols"), F.avg("cyclomatic_complexity").alias("complexity")).withColumn("complexity", F.round("complexity", 6)),
    "arity_buckets": lambda s, d: table(s, d, "symbols").dropDuplicates(["id"]).where("lower(trim(kind)) in ('function', 'method')").groupBy(S.arity(F.col("signature")).alias("arity")).agg(F.count("*").alias("symbols")),
    "urls": lambda s, d: _urls(table(s, d, "documents")),
    "section_ids": lambda s, d: table(s, d, "sections").dropDuplicates(["id"]).select("id", S.section_id(F.col("document_id"), F.coalesce("heading_path", F.array().cast("array<string>"))).alias("derived")),
    "content_hashes": lambda s, d: table(s, d, "documents").groupBy(S.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")),
}

QUERIES |= {
    "file_symbols": lambda s, d: code.read_symbols(table(s, d, "source_files")),
    "file_references": lambda s, d: code.read_references(table(s, d, "source_files")).groupBy("name", "kind").agg(F.count("*").alias("uses")),
    "file_occurrences": lambda s, d: code.read_occurrences(table(s, d, "source_files")).groupBy("path").agg(F.count("*").alias("occurrences"), F.countDistinct("name").alias("names")),
    "file_sections": lambda s, d: code.read_sections(table(s, d, "source_files")),
    "file_endpoints": lambda s, d: code.read_endpoints(table(s, d, "source_files")),
    "markdown_sections": lambda s, d: documents.read_markdown(table(s, d, "documents").select(F.col("source_path").alias("path"), F.col("text").alias("content"))),
    "parser_kinds": lambda s, d: table(s, d, "source_files").select("path", files.parser_kind(F.col("path")).alias("kind"), files.is_excluded(F.col("path")).alias("excluded")),
}


QUERIES |= {
    "document_list": lambda s, d: L.document_list(table(s, d, "documents"), table(s, d, "sections")),
    "absolute_paths": lambda s, d: L.absolute_paths(table(s, d, "source_files"), _roots(s, d)),
    "vector_names": lambda s, d: table(s, d, "id_map").select("int_id", S.name_from_id(F.col("vector_id")).alias("name")),
    "text_roles": lambda s, d: table(s, d, "sections").dropDuplicates(["id"]).select("id", S.roles(F.coalesce("text", F.lit(""))).alias("r")).select("id", "r.doc", "r.sig", "r.body"),
    "item_kinds": lambda s, d: table(s, d, "symbols").dropDuplicates(["id"]).groupBy(S.item_kind(F.concat(F.lower(F.trim("kind")), F.lit("_declaration"))).alias("item")).agg(F.count("*").alias("symbols")),
    "camel_names": lambda s, d: table(s, d, "symbols").select("name").distinct().select("name", S.snake_to_camel(F.col("name")).alias("camel")),
    "symbol_hints": lambda s, d: table(s, d, "eval_items").select("item_id", S.symbol_hints(F.col("text")).alias("hints"), S.bridge_relevant(F.col("text")).alias("bridge")),
    "detected_bridges": lambda s, d: frameworks.detect_bridges(table(s, d, "source_files")),
}


def _roots(s, d):
    """Folders of all repositories but those with a hyphenless name."""
    return table(s, d, "source_files").where("root_id like '%-%'").select("root_id").distinct().withColumn("folder", F.concat(F.lit("/corpora/"), F.col("root_id"), F.lit("/")))


def _urls(docs):
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[a-z0-9./_\-]+[a-z0-9/])"), 1)).alias("url"))
    return found.groupBy(S.normalize_url(F.col("url")).alias("url")).agg(F.count("*").alias("uses")).where("url is not null")


_INNER = r"regexp_replace(regexp_extract(signature, '\(([^()]*(?:\((?:[^()]|\([^()]*\))*\)[^()]*)*)', 1), '\((?:[^()]|\([^()]*\))*\)', 'P', 'g')"
ARITY = rf"CASE WHEN coalesce(regexp_replace({_INNER}, '[ \t\n]', '', 'g'), '') = '' THEN 0 ELSE least(length({_INNER}) - length(replace({_INNER}, ',', '')) + 1, 5) END::INT"

ORACLE = {
    "corpus_stats": """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM documents) AS chars,
        (SELECT count(DISTINCT id) FROM sections) AS sections, (SELECT count(DISTINCT id) FROM symbols) AS symbols""",
    "toc": rf"""SELECT document_id, position, id, depth, coalesce(array_to_string(heading_path, ' > '), '') AS heading,
        CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) END::INT AS words FROM {SECTIONS}""",
    "next_section": f"SELECT id, lead(id) OVER (PARTITION BY document_id ORDER BY position, id) AS next_id FROM {SECTIONS}",
    "symbol_definitions": f"""SELECT s.id, concat_ws(' > ', replace(s.module_path, '::', ' > '), s.name) AS heading,
        array_to_string(string_split(f.content, chr(10))[greatest(s.line_start - 3, 1):s.line_end + 3], chr(10)) AS source
        FROM {SYMBOLS} s LEFT JOIN source_files f ON f.path = s.file_path""",
    "language_stats": f"SELECT root_id, {_LANG} AS language, count(*) AS files FROM source_files GROUP BY ALL",
    "resolve_content": f"""SELECT 'section' AS resolution, id AS content_id, text FROM {SECTIONS}
        UNION ALL SELECT 'summary', id, summary FROM {SECTIONS} WHERE summary IS NOT NULL
        UNION ALL SELECT 'symbol-stub', id, concat_ws(chr(10), signature, doc_comment) FROM {SYMBOLS}
        UNION ALL SELECT 'symbol-full', id, concat_ws(chr(10), file_path || ':' || line_start || '-' || line_end, signature) FROM {SYMBOLS}""",
    "test_files": f"SELECT p AS path FROM (SELECT path AS p FROM source_files) WHERE {TEST_PATH}",
    "documents_by_root": "SELECT root_id, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(ingested_at) AS newest FROM documents GROUP BY 1",
    "section_documents": f"SELECT s.id, d.doc_id, d.title, s.position FROM {SECTIONS} s JOIN documents d ON d.source_path = s.document_id",
    "orphan_sections": "SELECT DISTINCT id, document_id FROM sections WHERE document_id NOT IN (SELECT source_path FROM documents)",
    "symbol_kinds": f"SELECT lower(trim(kind)) AS kind, count(*) AS symbols, round(avg(cyclomatic_complexity), 6) AS complexity FROM {SYMBOLS} GROUP BY 1",
    "arity_buckets": f"SELECT {ARITY} AS arity, count(*) AS symbols FROM {SYMBOLS} WHERE lower(trim(kind)) IN ('function', 'method') GROUP BY 1",
    "urls": r"""WITH u AS (SELECT unnest(regexp_extract_all(text, '(https?://[a-z0-9./_\-]+[a-z0-9/])', 1)) AS url FROM documents)
        SELECT CASE WHEN NOT ends_with(url, '/') AND NOT contains(regexp_extract(regexp_extract(url, '^https?://[^/]*((?:/[^/]*)*)$', 1), '([^/]*)$', 1), '.') THEN url || '/' ELSE url END AS url, count(*) AS uses
        FROM u GROUP BY 1""",
    "section_ids": rf"""SELECT id, document_id || '#' || CASE WHEN heading_path IS NOT NULL AND len(heading_path) > 0
        THEN array_to_string(list_transform(heading_path, lambda h: regexp_replace(regexp_replace(lower(h), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')), '/') ELSE 'root' END AS derived FROM {SECTIONS}""",
    "content_hashes": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1",
}
_QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_LINE_SIGN = " OR ".join(f"starts_with(regexp_replace(x, '^\\s+', ''), '{p}')" for p in S.SOURCE_PREFIXES)
_KIND = "CASE " + " ".join(f"WHEN k IN ({_QUOTED(nodes.split())}) THEN '{kind}'" for kind, nodes in S.NODE_KINDS.items()) + " " + " ".join(f"WHEN contains(k, '{part}') THEN '{kind}'" for part, kind in S.NODE_PARTS) + " END"
_MARKERS = ", ".join(f"('{m}', '{marker}', '{kind}')" for m, markers in frameworks.MARKERS.items() for marker, kinds in markers.items() for kind in kinds.split())
ORACLE |= {
    "document_list": "SELECT source_path, title, root_id, count(DISTINCT s.id) AS sections FROM documents d LEFT JOIN sections s ON s.document_id = d.source_path GROUP BY ALL",
    "absolute_paths": "SELECT path, CASE WHEN root_id LIKE '%-%' AND starts_with(path, root_id || '/') THEN '/corpora/' || path ELSE path END AS absolute FROM source_files",
    "vector_names": "SELECT int_id, replace(CASE WHEN contains(vector_id, '#') THEN regexp_extract(vector_id, '([^#]*)$', 1) ELSE string_split(vector_id, '::')[-1] END, '::', ' ') AS name FROM id_map",
    "text_roles": rf"""WITH l AS (SELECT id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM {SECTIONS}), f AS (SELECT id, ls, coalesce(list_position(list_transform(ls, lambda x: {_LINE_SIGN}), true), 0) AS k FROM l)
        SELECT id, array_to_string(CASE WHEN k = 0 THEN ls ELSE ls[1:k - 1] END, ' ') AS doc, CASE WHEN k = 0 THEN '' ELSE ls[k] END AS sig, CASE WHEN k = 0 THEN '' ELSE array_to_string(ls[k + 1:], ' ') END AS body FROM f""",
    "item_kinds": f"WITH x AS (SELECT lower(trim(kind)) || '_declaration' AS k FROM {SYMBOLS}) SELECT {_KIND} AS item, count(*) AS symbols FROM x GROUP BY 1",
    "camel_names": "SELECT DISTINCT name, array_to_string(list_transform(string_split(name, '_'), lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(p[1:1]) || p[2:] END), '') AS camel FROM symbols",
    "symbol_hints": rf"""SELECT item_id, list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) >= 3 AND lower(w) NOT IN ({_QUOTED(S.HINT_STOP)})) AS hints,
        ({" OR ".join(f"contains(lower(text), '{w}')" for w in S.BRIDGE_WORDS)}) AS bridge FROM eval_items""",
    "detected_bridges": rf"""WITH m(name, marker, kind) AS (VALUES {_MARKERS}), f AS (SELECT root_id, regexp_extract(path, '([^/]*)$', 1) AS name, coalesce(content, '') AS content, lower(regexp_extract(path, '\.([A-Za-z]+)$', 1)) AS e FROM source_files)
        SELECT DISTINCT root_id, kind FROM f JOIN m ON m.name = f.name AND contains(content, marker) UNION SELECT root_id, 'ffi' FROM f WHERE e IN ({_QUOTED(frameworks.C_ENDINGS)}) UNION SELECT root_id, 'grpc' FROM f WHERE e = 'proto'
        UNION SELECT root_id, 'cgo' FROM f GROUP BY 1 HAVING bool_or(e IN ({_QUOTED(frameworks.C_ENDINGS)})) AND bool_or(name = 'go.mod')""",
}
