"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import chunking, credentials, docpairs, knn, leakage, packing, provenance, sentences, syntax
from lodestrata.session import table

PROSE = ("guide", "adr", "note", "faq")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    sections = credentials.find_secrets(table(spark, d, "sections"), "sections", "id", "text")
    symbols = credentials.find_secrets(table(spark, d, "symbols"), "symbols", "id", "signature")
    return sections.unionByName(symbols)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("tab", "record_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    sections = credentials.redacted(table(spark, d, "sections"), "text").select(F.lit("sections").alias("tab"), F.col("id").alias("record_id"), F.col("text").alias("redacted"))
    symbols = credentials.redacted(table(spark, d, "symbols"), "signature").select(F.lit("symbols").alias("tab"), F.col("id").alias("record_id"), F.col("signature").alias("redacted"))
    return sections.unionByName(symbols)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized_sections(table(spark, d, "sections"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_pieces(table(spark, d, "sections"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.found_pairs(table(spark, d, "vectors"), table(spark, d, "id_map"), table(spark, d, "hnsw_config"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.live_neighbours(table(spark, d, "vectors"), table(spark, d, "id_map"), table(spark, d, "hnsw_config"), whole=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "source_files")).select("path")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify(table(spark, d, "source_files"), table(spark, d, "upstream_files")).select("path")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify(table(spark, d, "source_files"), table(spark, d, "upstream_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "symbols")).select("symbol_id").distinct()


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "symbols"))


def p6_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.file_pairs(table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents").where(F.col("doc_kind").isin(*PROSE)))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p2_found, p2_pieces, p3_found, p3_neighbours, p4_found, p4_rates, p5_found, p5_classes,
        p6_found, p6_pairs, p6_file_pairs, p7_found, p7_pack, p8_found, p8_spans, p9_found, p9_sentences,
    )
}

_LIVE = """live AS (SELECT int_id AS id, min(vector)::DOUBLE[] AS v FROM vectors, hnsw_config JOIN id_map ON NOT coalesce(deleted, false) AND int_id IS NOT NULL WHERE vector_id = resolution || '::' || content_id AND len(vector) = dimension
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
 pr AS (SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.v, b.v) AS cosine FROM live a JOIN live b ON a.id <> b.id),
 nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other) AS r FROM pr QUALIFY r <= 5)"""

ORACLE: dict[str, str] = {
    "p3_found": f"WITH {_LIVE} SELECT DISTINCT least(id, other) AS int_a, greatest(id, other) AS int_b FROM nn WHERE cosine >= 0.85",
    "p3_neighbours": f"WITH {_LIVE} SELECT id, r::INT AS rank, other AS neighbour, cosine FROM nn",
    "p2_found": """
        SELECT DISTINCT id AS section_id FROM sections
        WHERE length(coalesce(text, ''))
            + CASE WHEN heading_path IS NOT NULL AND len(heading_path) > 0 THEN length(array_to_string(heading_path, ' > ')) + 1 ELSE 0 END > 2000
    """,
}
