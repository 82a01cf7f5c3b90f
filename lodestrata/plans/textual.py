"""Queries over texts: claims, summaries, terms, paragraphs, code detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import lookup as L
from lodestrata.operators import text as T
from lodestrata.plans.lookups import SECTIONS
from lodestrata.session import table


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sections(s, d):
    return table(s, d, "sections").dropDuplicates(["id"])


def _related(s, d):
    """Claims and sections with claims of each document."""
    c = T.claims(_sections(s, d)).join(_sections(s, d).select(F.col("id").alias("section_id"), "document_id", F.col("position").alias("at")), "section_id")
    return c.groupBy("document_id").agg(F.count("*").alias("claims"), F.countDistinct("section_id").alias("sections"))


def _compressed(s, d):
    sections = _sections(s, d).where("text is not null")
    both = sections.select("id", F.col("text").alias("original")).join(T.summaries(sections, 2), "id").withColumnRenamed("summary", "compressed")
    return T.compression_quality(both)


QUERIES = {
    "claims": lambda s, d: T.claims(_sections(s, d)),
    "claims_by_document": _related,
    "summary3": lambda s, d: T.summaries(_sections(s, d).where("text is not null"), 3),
    "significant_terms": lambda s, d: _sections(s, d).select(F.explode(T.significant_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("sections")),
    "paragraphs": lambda s, d: T.paragraphs(_sections(s, d).where("text is not null")),
    "coalesced_sections": lambda s, d: T.coalesced(table(s, d, "sections")),
    "code_sections": lambda s, d: _sections(s, d).where(T.looks_like_code(F.col("text"))).select("id"),
    "contextualised": lambda s, d: _sections(s, d).select("id", T.contextualised(F.col("text"), F.col("heading_path")).alias("text")),
    "compression_quality": _compressed,
    "toc_claims": lambda s, d: L.toc(table(s, d, "sections"), T.claims(_sections(s, d))).select("id", "words", "claims"),
    "claim_terms": lambda s, d: T.term_index(T.claims(_sections(s, d))).groupBy("term").agg(F.count("*").alias("claims")),
    "document_summaries": lambda s, d: T.summaries(table(s, d, "documents").where("text is not null").withColumnRenamed("doc_id", "id"), 5),
    "structured_claims": lambda s, d: T.structured_claims(_sections(s, d).where("text is not null")),
    "salient_summaries": lambda s, d: T.salient_summaries(_sections(s, d).where("text is not null"), ["budget", "session", "index"], 2),
    "compressed_by_kind": lambda s, d: T.compressed_by_kind(_contents(s, d), 2),
}


def _contents(s, d):
    """Sections, source files, and claims, each under its own id."""
    sections = _sections(s, d)
    return sections.select("id", "text").unionByName(table(s, d, "source_files").select(F.col("path").alias("id"), F.col("content").alias("text"))).unionByName(T.claims(sections).select(F.col("claim_id").alias("id"), "text"))


_CUT, _MASK = "chr(1)", "chr(2)"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_CLAIM_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '{T.masked_pattern()}', '\1\2' || {_MASK}, 'g'), '([.!?])(\s*)([\p{{Lu}}"])', '\1' || {_CUT} || '\2\3', 'g'), {_CUT}),
    lambda s: regexp_replace(replace(s, {_MASK}, '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_PATTERNS = " OR ".join(f"contains(lower(s), ' {p} ')" for p in T.ASSERTION_PATTERNS)
_CLAIMS = rf"""
WITH raw AS (SELECT id, {_CLAIM_SENTENCES} AS ss FROM {SECTIONS} WHERE text IS NOT NULL),
one AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM raw),
words AS (SELECT id, s, i, {_WORDS.format('s')} AS w, list_transform({_WORDS.format('lower(s)')}, lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS lw FROM one),
scored AS (SELECT id, s, i, CASE WHEN ends_with(s, '?') THEN 0 ELSE
    (CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN 2 ELSE 0 END)
  + (CASE WHEN list_has_any(lw, {_list(T.ASSERTIVE_VERBS)}) THEN 1 ELSE 0 END)
  + (CASE WHEN len(list_filter(w[2:], lambda x: regexp_matches(x, '^\p{{Lu}}') AND strlen(x) > 1 AND NOT list_contains({_list(T.COMMON_CAPITALS)}, x))) > 0 THEN 1 ELSE 0 END)
  + (CASE WHEN {_PATTERNS} THEN 1 ELSE 0 END) END AS score, len(w) AS n FROM words),
kept AS (SELECT id AS section_id, s AS text, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS position FROM scored WHERE score >= 2 AND n BETWEEN 4 AND 60)
"""
_SUMMARY = rf"""
WITH raw AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(\s*)(\p{{Lu}})', '\1' || {_CUT} || '\2\3', 'g'), {_CUT}), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM {SECTIONS} WHERE text IS NOT NULL),
one AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i, len(ss) AS n FROM raw),
tok AS (SELECT id, i, n, list_filter(list_transform({_WORDS.format('s')}, lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g'))), lambda x: x <> '' AND NOT list_contains({_list(T.SUMMARY_STOP)}, x)) AS t FROM one),
tf AS (SELECT id, i, n, len, term, count(*) AS tf FROM (SELECT id, i, n, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT *, count(*) OVER (PARTITION BY id, term) AS df FROM tf),
sc AS (SELECT id, i, round(sum(tf / len * ln(n / df)) / first(len), 9) AS score FROM df GROUP BY 1, 2),
rk AS (SELECT one.id, one.i, one.s, row_number() OVER (PARTITION BY one.id ORDER BY coalesce(score, 0.0) DESC, one.i) AS r FROM one LEFT JOIN sc ON sc.id = one.id AND sc.i = one.i)
"""
_TERMS = rf"""list_distinct(list_transform(list_filter(list_transform({_WORDS.format('{0}')}, lambda x: regexp_replace(x, '[^\p{{{{L}}}}\p{{{{N}}}}_\-]', '', 'g')),
    lambda x: strlen(x) >= 2 AND NOT list_contains({_list(T.RELATION_STOP)}, lower(x)) AND (regexp_matches(x, '[0-9]') OR regexp_matches(x, '^\p{{{{Lu}}}}') OR strlen(x) >= 4)), lambda x: lower(x)))"""

ORACLE = {
    "claims": _CLAIMS + "SELECT section_id || ':c' || position AS claim_id, section_id, text, position FROM kept",
    "claims_by_document": _CLAIMS + f"SELECT document_id, count(*) AS claims, count(DISTINCT section_id) AS sections FROM kept JOIN {SECTIONS} x ON x.id = kept.section_id GROUP BY 1",
    "summary3": _SUMMARY + "SELECT id, string_agg(s, ' ' ORDER BY i) AS summary FROM rk WHERE r <= 3 GROUP BY 1",
    "significant_terms": f"SELECT term, count(*) AS sections FROM (SELECT unnest({_TERMS.format('text')}) AS term FROM {SECTIONS} WHERE text IS NOT NULL) GROUP BY 1",
    "paragraphs": rf"""WITH x AS (SELECT id, depth, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps,
        len({_WORDS.format('text')}) AS n FROM {SECTIONS} WHERE text IS NOT NULL),
        y AS (SELECT id, CASE WHEN depth = 0 AND n > 500 AND len(ps) >= 2 THEN ps ELSE [text] END AS ps FROM x)
        SELECT id AS section_id, (generate_subscripts(ps, 1) - 1)::INT AS piece, unnest(ps) AS text FROM y""",
    "code_sections": rf"""WITH x AS (SELECT id, text, list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '') AS ls FROM {SECTIONS} WHERE text IS NOT NULL)
        SELECT id FROM x WHERE {" OR ".join(f"contains(text, '{m}')" for m in T.CODE_MARKERS)}
        OR (len(ls) > 0 AND len(list_filter(ls, lambda l: {" OR ".join(f"contains(l, '{m}')" for m in T.CODE_SIGNS)})) >= 0.3 * len(ls))""",
    "contextualised": rf"""WITH x AS (SELECT id, text, heading_path AS h, CASE WHEN heading_path IS NOT NULL AND len(heading_path) > 0
        THEN array_to_string([regexp_extract(heading_path[1], '([^/]*)$', 1)] || heading_path[2:], ' › ') || chr(10) || chr(10) END AS head FROM {SECTIONS})
        SELECT id, CASE WHEN head IS NOT NULL AND text IS NOT NULL AND NOT starts_with(text, head) THEN head || text ELSE text END AS text FROM x""",
    "compression_quality": _SUMMARY + rf""", sm AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS c FROM rk WHERE r <= 2 GROUP BY 1),
        b AS (SELECT x.id, len({_WORDS.format('x.text')}) AS wo, len({_WORDS.format('sm.c')}) AS wc, {_TERMS.format('x.text')} AS ta, {_TERMS.format('sm.c')} AS tb FROM {SECTIONS} x JOIN sm ON sm.id = x.id),
        q AS (SELECT id, CASE WHEN wo > 0 THEN wc / wo ELSE 1.0 END AS ratio, CASE WHEN len(ta) > 0 THEN len(list_intersect(ta, tb)) / len(ta) ELSE 1.0 END AS retention, CASE WHEN wc > 0 THEN len(tb) / wc ELSE 0.0 END AS density FROM b)
        SELECT id, round(ratio, 6) AS ratio, round(retention, 6) AS retention, round(least(1.0, greatest(0.0, 0.6 * retention + 0.3 * (1 - ratio) + 0.1 * density)), 6) AS quality FROM q""",
}
_COUNT = _WORDS.format("text")
ORACLE |= {
    "toc_claims": _CLAIMS + f"SELECT x.id, CASE WHEN x.text IS NULL THEN 0 ELSE len({_COUNT.replace('text', 'x.text')}) END::INT AS words, count(k.section_id) AS claims FROM {SECTIONS} x LEFT JOIN kept k ON k.section_id = x.id GROUP BY x.id, x.text",
    "claim_terms": _CLAIMS + f"SELECT term, count(*) AS claims FROM (SELECT unnest({_TERMS.format('text')}) AS term FROM kept) GROUP BY 1",
    "document_summaries": _SUMMARY.replace(SECTIONS, "(SELECT doc_id AS id, text FROM documents)") + "SELECT id, string_agg(s, ' ' ORDER BY i) AS summary FROM rk WHERE r <= 5 GROUP BY 1",
    "structured_claims": _CLAIMS + f"SELECT x.id, c AS compressed FROM (SELECT section_id, string_agg(text, ' | ' ORDER BY position) AS c FROM kept GROUP BY 1) k JOIN {SECTIONS} x ON x.id = k.section_id WHERE strlen(c) < strlen(x.text)",
}
